"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are spans of four kinds (code points, end exclusive): ``assign``, ``access`` and ``hex``, the base, and ``other``
(keys with well-known prefixes, web tokens, private key headers). The value of each candidate is hashed, and the hashes are
aggregated over the whole corpus by distinct repositories and owners, after partial aggregation by (hash, repository,
owner), so a value in a third of all rows costs one row per task. A value seen in at least ``min_repos`` repositories of
``min_owners`` owners is a widely copied *example*; any other is owner-specific and counts as *live*.

Spans come from one pass of ``regexp_extract_all`` and, for texts with matches, ``split``: a match starts after all the
pieces and matches before it. The sums of lengths are taken in levels of ``WIDE`` elements (:func:`running`), so the work grows in proportion to the matches of a text.

Owners and repositories: ``owner`` and ``repo`` are expressions over the documents' columns. The test tables know a source only; without ``repo`` a source is one repository of one owner, and the count
of repositories is idle.

A value that can't be live is neither: a *placeholder* (:func:`placeholder`) has at most two different characters, or holds a word such as ``example`` or ``changeme``.

Cases: null text counts as empty (no spans, sha256 of nothing). Equal rows, also with equal ids, are rows of their own
and count once for a repository. A null source is no repository and no owner. A null id stays null. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Kind, pattern, group that is the value, least length of that group.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("other", r"gh[opusr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:bigint,dummy:boolean>>"


#: Elements that a running sum takes at once.
WIDE = 256
#: Words of values that are no secrets.
DUMMY = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]|x{6}|<|\.\.\."


def let(body, **values: Column) -> Column:
    """``body`` of a struct of values. They are computed once: a column that only a lambda refers to would be computed again for every element."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def running(rows: DataFrame, out: str, values: str, step, zero: Column, levels: int = 1) -> DataFrame:
    """Adds ``out``, the array of ``step`` over all elements of ``values`` before each one (exclusive), in time proportional to their number: over pieces of ``WIDE`` elements, from what comes before each
    piece, which is found the same way. Each step is a column of its own, since a nested expression would repeat itself."""

    def within(piece: Column, first: Column) -> Column:
        """Over one short piece, from ``first`` on."""
        begin = F.struct(first.alias("at"), F.slice(F.array(first), F.lit(1), F.lit(0)).alias("out"))
        return F.aggregate(piece, begin, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    names = [values, *(f"_{out}{k}" for k in range(1, levels + 1))]
    for k in range(levels):
        have, pieces = names[k], f"_{out}p{k}"
        count = F.greatest(F.ceil(F.size(have) / WIDE), F.lit(1)).cast("int")
        rows = rows.withColumn(pieces, let(lambda e: F.transform(F.sequence(F.lit(1), e["n"]), lambda i: F.slice(e["a"], (i - 1) * WIDE + 1, F.lit(WIDE))), a=F.col(have), n=count))
        rows = rows.withColumn(names[k + 1], F.transform(pieces, lambda p: F.aggregate(p, zero, step)))
    rows = rows.withColumn(f"_{out}b{levels}", within(F.col(names[levels]), zero))
    for k in reversed(range(levels)):
        rows = rows.withColumn(f"_{out}b{k}", F.flatten(F.zip_with(f"_{out}p{k}", f"_{out}b{k + 1}", within)))
    return rows.withColumn(out, F.col(f"_{out}b0")).drop(*names[1:], *(f"_{out}p{k}" for k in range(levels)), *(f"_{out}b{k}" for k in range(levels + 1)))


def placeholder(value: Column) -> Column:
    """Values that are nobody's: at most two different characters, or a word that says so."""
    return value.rlike(DUMMY) | (F.size(F.array_distinct(F.array_remove(F.split(value, ""), ""))) <= 2)


def _matched(rows: DataFrame, order: int, pattern: str, group: int, least: int, unit) -> DataFrame:
    """Adds the column ``s{order}``: spans of one kind as array<struct<start, kind, end, value hash>>, in characters or bytes by ``unit``."""
    text, p, at = F.col("text"), F.lit(pattern), f"s{order}"
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else F.col("w")
    parts = F.when(F.size("w") > 0, F.slice(F.split(text, pattern, -1), F.lit(1), F.size("w"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("w", whole).withColumn("v", value).withColumn("p", parts)
    rows = rows.withColumn("n", F.zip_with("p", "w", lambda p, w: (unit(p) + unit(w)).cast("long")))
    rows = running(rows, "b", "n", lambda a, x: a + x, F.lit(0).cast("long"))
    ends = F.zip_with("b", "n", lambda b, n: F.struct(b.alias("b"), (b + n).alias("e")))
    made = F.zip_with(
        F.zip_with(ends, "p", lambda x, p: F.struct((x["b"] + unit(p)).alias("start"), x["e"].alias("end"))),
        "v",
        lambda x, v: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"), F.xxhash64(v).alias("value"), placeholder(v).alias("dummy"), (F.length(v) >= least).alias("long")),
    )
    plain = F.transform(F.filter(made, lambda s: s["long"]), lambda s: F.struct(*(s[n].alias(n) for n in ("start", "kind", "end", "value", "dummy"))))
    return rows.withColumn(at, F.when(F.size("w") > 0, plain).otherwise(F.array().cast(SPAN))).drop("w", "v", "p", "n", "b")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def find_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, unit=F.length) -> DataFrame:
    """k1, k2 (the row's key), owner, repo, found: all spans by start, then kind."""
    owner = F.col("source") if owner is None else owner
    repo = owner if repo is None else repo
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("k1"), F.xxhash64(text).alias("k2"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), text.alias("text"))
    for i, k in enumerate(KINDS):
        rows = _matched(rows, i, *k[1:], unit)
    return rows.select("k1", "k2", "owner", "repo", F.array_sort(F.concat(*(f"s{i}" for i in range(len(KINDS))))).alias("found"))


def value_owners(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over all rows."""
    values = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"))
    pairs = values.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("value").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def judged(found: DataFrame, min_repos: int, min_owners: int) -> DataFrame:
    """k1, k2, examples: the hashes among a row's values that are widely copied; only rows that have any."""
    wide = value_owners(found).filter((F.col("n_repos") >= min_repos) & (F.col("n_owners") >= min_owners)).select("value")
    rows = found.filter(F.size("found") > 0).select("k1", "k2", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"))
    return rows.join(wide, "value").groupBy(F.col("k1").alias("e1"), F.col("k2").alias("e2")).agg(F.collect_set("value").alias("examples"))


def _with_examples(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """Adds to each span whether its value is an example. A row's examples are looked up by hash where it has many."""
    joined = rows.join(examples, F.col("k1").eqNullSafe(F.col("e1")) & (F.col("k2") == F.col("e2")), "left").drop("e1", "e2")
    distinct = F.array_distinct(F.transform("found", lambda s: s["value"]))
    known = F.map_from_entries(F.transform(F.array_intersect(distinct, F.coalesce("examples", F.array().cast("array<bigint>"))), lambda v: F.struct(v, F.lit(True))))
    held = let(lambda e: F.transform(e["found"], lambda s: s.withField("example", F.coalesce(F.try_element_at(e["known"], s["value"]), F.lit(False)))), found=F.col("found"), known=known)
    return joined.withColumn("found", held).drop("examples")


def secret_scan(documents: DataFrame, min_repos: int = 3, min_owners: int = 3, **cols) -> DataFrame:
    """One row per document: counts by kind, base_sha256, spans, and how many spans are live and examples."""
    found = materialise(find_spans(documents, **cols))
    rows = _with_examples(found, judged(found, min_repos, min_owners))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return rows.select(
        F.col("k1").alias("doc_id"),
        *(count(_of_kind(i)).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        count(lambda s: ~s["example"] & ~s["dummy"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"),
        count(lambda s: ~s["example"] & s["dummy"]).alias("n_placeholder"),
    )


def mask_secrets(documents: DataFrame, min_repos: int = 3, min_owners: int = 3, live_mark: str = "<SECRET>", example_mark: str = "<EXAMPLE>", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **cols) -> DataFrame:
    """The documents with their spans replaced by a mark, live ones by another than widely copied examples and placeholders.

    Overlapping spans become one mark (a live one if any of them is live). Texts without spans aren't shuffled."""
    found = materialise(find_spans(documents, id_col, text_col, unit=F.octet_length, **cols))
    hit = found.filter(F.size("found") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", "found")
    hit = _with_examples(hit, judged(found, min_repos, min_owners)).select(F.col("k1").alias("_s1"), F.col("k2").alias("_s2"), F.transform("found", lambda s: F.struct(s["start"], s["end"], (s["example"] | s["dummy"]).alias("harmless"))).alias("s"))
    # overlapping spans are one: it starts where no span before it reaches to, and is harmless if all of them are
    hit = hit.withColumn("ends", F.transform("s", lambda x: x["end"])).withColumn("lives", F.transform("s", lambda x: F.when(x["harmless"], 0).otherwise(1).cast("long")))
    hit = running(hit, "reach", "ends", lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
    hit = running(hit, "live", "lives", lambda a, x: a + x, F.lit(0).cast("long"))
    hit = hit.withColumn("all", F.array_max("ends")).withColumn("any", F.element_at("live", -1) + F.element_at("lives", -1))

    def head(e):
        first = lambda x, i: (i == 0) | (x["start"] >= F.get(e["reach"], i))
        return F.filter(F.transform(e["s"], lambda x, i: F.when(first(x, i), F.struct(x["start"].alias("start"), F.get(e["reach"], i).alias("before"), F.get(e["live"], i).alias("live")))), lambda x: x.isNotNull())

    hit = hit.withColumn("heads", let(head, s=F.col("s"), reach=F.col("reach"), live=F.col("live")))

    def cut(e):
        after = lambda i, name, end: F.coalesce(F.get(e["heads"], i + 1)[name], e[end])
        return F.transform(e["heads"], lambda h, i: F.struct(h["before"].alias("from"), h["start"].alias("to"), after(i, "before", "all").alias("end"), (after(i, "live", "any") == h["live"]).alias("harmless")))

    cuts = let(cut, heads=F.col("heads"), all=F.col("all"), any=F.col("any"))
    hit = hit.select("_s1", "_s2", cuts.alias("_spans"))
    # whole rows travel as one struct, so that no column of theirs can clash with ours
    text = F.coalesce(F.col(text_col), F.lit(""))
    any_match = text.rlike("|".join(f"(?:{k[1]})" if not k[1].startswith("(?i)") else f"(?i:{k[1][4:]})" for k in KINDS))
    clean = documents.filter(~any_match)
    rows = documents.filter(any_match).select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_k2"))
    joined = rows.join(hit, F.col("_id").eqNullSafe(F.col("_s1")) & (F.col("_k2") == F.col("_s2")), "left")
    # spans are cut out by bytes: a cut by characters would count from the text's start every time
    mark = lambda s: F.when(s["harmless"], F.lit(example_mark)).otherwise(F.lit(live_mark))

    def masked(e):
        part = lambda lo, n: F.substring(e["text"], (lo + 1).cast("int"), n.cast("int")).cast("string")
        pieces = F.transform(e["spans"], lambda s: F.concat(part(s["from"], s["to"] - s["from"]), mark(s)))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(e["spans"], -1)["end"], F.octet_length(e["text"])))

    text = let(masked, spans=F.col("_spans"), text=F.col("_row")[text_col].cast("binary"))
    row = F.col("_row").withField(text_col, F.when(F.size("_spans") > 0, text).otherwise(F.col("_row")[text_col]))
    changed = joined.select(row.alias("_row"))
    if length_col and length_col in documents.columns:
        changed = changed.select(F.col("_row").withField(length_col, F.length(F.col("_row")[text_col]).cast(documents.schema[length_col].dataType)).alias("_row"))
    return clean.unionAll(changed.select("_row.*"))


def _duck_kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT k, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
    'kind': {order}, 'name': '{kind}', 'len': length(m[i]), 'v': v[i]}}), lambda s: length(s.v) >= {least}) AS s
  FROM (SELECT k, regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {group}) v, string_split_regex(t, '{p}') parts FROM docs)"""


def oracle_sql(min_repos: int = 3, min_owners: int = 3) -> str:
    """The same rows in DuckDB's SQL."""
    kinds = "\n  UNION ALL".join(_duck_kind(i, *k) for i, k in enumerate(KINDS))
    return f"""
WITH docs AS (SELECT row_number() OVER () k, doc_id, source, coalesce(text, '') t FROM documents),
found AS ({kinds}),
spans AS (SELECT k, unnest(s) s FROM found),
wide AS (SELECT s.v v FROM spans JOIN docs USING (k) GROUP BY s.v HAVING count(DISTINCT source) >= {max(min_repos, min_owners)}),
judged AS (SELECT s.v v, regexp_matches(s.v, '{DUMMY}') OR len(list_distinct(string_split(s.v, ''))) <= 2 dummy FROM spans GROUP BY s.v),
rows AS (SELECT k, s.kind, s.name || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.len AS BIGINT) w, s.start st, (w.v IS NOT NULL) ex, dummy FROM spans LEFT JOIN wide w ON s.v = w.v JOIN judged j ON s.v = j.v),
agg AS (SELECT k, count(*) FILTER (kind = 0) a, count(*) FILTER (kind = 1) b, count(*) FILTER (kind = 2) c, string_agg(w, ',' ORDER BY st, kind) FILTER (kind < 3) base,
  string_agg(w, ',' ORDER BY st, kind) al, count(*) FILTER (NOT ex AND NOT dummy) live, count(*) FILTER (ex) ex, count(*) FILTER (NOT ex AND dummy) dummies FROM rows GROUP BY k)
SELECT doc_id, coalesce(a, 0) n_assign, coalesce(b, 0) n_access, coalesce(c, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(al, '') spans, coalesce(live, 0) n_live, coalesce(ex, 0) n_example, coalesce(dummies, 0) n_placeholder
FROM docs LEFT JOIN agg USING (k)"""
