"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

1. Sizes: a document's size is its number of words (runs without the ASCII blanks \\x20, \\x09 to \\x0D).
2. Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share 100 % of all sizes. No target exceeds
   ``max_repeat`` (3) times its source's size; the excess is shared again by weight. With the sources sorted by cap per weight
   the level is the largest (rest of total) / (rest of weight), so one window finds it.
3. Seats: blocks of ``block_tokens`` words go to sources by the highest quotients target / (2 q + 1). Rounding by one divisor gives
   the Sainte-Laguë result for a total near the wanted one; only the few seats up or down from there are ranked by quotients, so no
   list of all seats is ever made. The quota of a source goes to its shards (about ``shard_tokens`` words each, documents dealt by a seeded
   hash) in the same way.
4. Blocks: in a shard, documents lie in a seeded order, cut into blocks. Whole rounds of a quota take every block; the rest of the quota takes blocks in a seeded
   order of their own, until it is used up: block b comes at (a b + c) mod blocks, a prime a and a shift c by seed and shard, so a document finds by itself which of its blocks
   are taken and no block is a row. No document is taken more than ``max_repeat`` times its size.

The same input and seed give the same result, whatever the partitioning.

Scale: aggregates and windows over documents run by (source, shard), so a source with a third of all rows is as many shards. The windows over sources see one row per source; the quotas of
shards go by groups of ``GROUP`` shards first, so no window sees more rows than the square root of the shards of a source, or ``GROUP``.

Cases: null and empty texts have size 0 and are never taken. Equal rows, also with equal ids, are rows of their own (which of
them takes a last block is open; the rows are the same as a whole). A source whose documents have no words has target 0. A null id stays null. An empty table gives no rows.
Other columns are kept only by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Primes over any number of blocks, so that each permutes all blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543)
#: Shards that share one window when quotas are dealt.
GROUP = 4096


def sainte_lague(rows: DataFrame, group: list[str], value: str, house: str, order: list[Column], quota: str) -> DataFrame:
    """Adds ``quota``: the seats of each row of its group out of ``house``, by highest quotients of ``value``; ties go by ``order``."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    q0 = F.when((F.col("_sum") > 0) & (F.col(house) > 0), F.floor(F.col(value) / (F.col("_sum") / F.col(house)) + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_row", F.row_number().over(whole.orderBy(*order))).withColumn("_sum", F.sum(value).over(whole)).withColumn("_q", q0)
    rows = rows.withColumn("_diff", F.when(F.col("_sum") > 0, F.col(house) - F.sum("_q").over(whole)).otherwise(F.lit(0))).withColumn("_n", F.count(F.lit(1)).over(whole))
    most = F.ceil((F.abs("_diff") + F.col("_n")) * F.col(value) / F.col("_sum")).cast("int") + 2
    steps = F.when(F.col("_diff") == 0, F.array(F.lit(0))).when(F.col("_diff") > 0, F.sequence(F.lit(0), most)).otherwise(F.sequence(F.lit(0), F.least(most, F.col("_q").cast("int"))))
    up = F.col("_diff") > 0
    tried = rows.withColumn("_j", F.explode(steps))
    quotient = F.when(up, F.col(value) / (2 * (F.col("_q") + F.col("_j")) + 1)).otherwise(F.when(F.col("_q") > F.col("_j"), -F.col(value) / (2 * (F.col("_q") - F.col("_j")) - 1)))
    rank = F.row_number().over(whole.orderBy(quotient.desc_nulls_last(), F.when(up, F.col("_row")).otherwise(-F.col("_row")), "_j"))
    moved = F.when((rank <= F.abs("_diff")) & quotient.isNotNull(), F.signum("_diff")).otherwise(F.lit(0))
    tried = tried.withColumn("_move", moved.cast("long"))
    keep = [c for c in rows.columns if not c.startswith("_")]
    return tried.groupBy(*keep, "_q").agg(F.sum("_move").alias("_move")).select(*keep, (F.col("_q") + F.col("_move")).alias(quota))


def source_targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """source, source_size, target for ``sizes`` (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    by = by.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    by = by.withColumn("cap", max_repeat * F.col("source_size")).withColumn("total", F.sum("source_size").over(one))
    filled = one.orderBy(F.col("cap") / F.col("weight"), "rank")
    rest_cap = F.col("total") - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest_weight = F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", rest_cap / rest_weight).withColumn("top", F.max("level").over(one))
    return by.select("source", "source_size", "rank", "total", F.least(F.col("cap").cast("double"), F.col("top") * F.col("weight")).alias("target"))


def _number(text: Column) -> Column:
    """The first 32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _seeded(seed: int, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _places(documents: DataFrame, seed: int, block_tokens: int, shard_tokens: int, max_repeat: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per document: k1, k2, source, size, source_size, target, its first word's place lo among the s_size words of its shard, the whole rounds that the shard's quota takes, the words of the rest, and the order of
    its blocks (step, shift, and when the last block comes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = materialise(
        documents.select(F.col(id_col).cast("long").alias("k1"), F.md5(text).alias("k2"), F.col(source_col).cast("string").alias("source"), text.alias("t")).select("k1", "k2", "source", F.regexp_count("t", F.lit(WORD)).cast("long").alias("size"))
    )
    targets = source_targets(sizes, max_repeat)
    seats = sainte_lague(targets.withColumn("house", F.round(F.col("total") / block_tokens).cast("long")), [], "target", "house", [F.col("rank")], "quota")
    seats = seats.select(F.col("source").alias("src"), "source_size", "target", "quota", "rank", F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).alias("shards"))
    seats = materialise(seats)
    docs = sizes.join(seats, F.col("source").eqNullSafe(F.col("src"))).withColumn("key", _seeded(seed, F.col("k1"), F.col("k2")))
    docs = docs.withColumn("shard", _number(F.concat(F.lit("shard:"), "key")) % F.col("shards"))
    per_shard = docs.groupBy("rank", "shard", "quota").agg(F.sum("size").alias("s_size")).withColumn("part", F.floor(F.col("shard") / GROUP))
    per_part = sainte_lague(per_shard.groupBy("rank", "part", "quota").agg(F.sum("s_size").alias("p_size")), ["rank"], "p_size", "quota", [F.col("part")], "p_quota")
    per_part = per_part.select(F.col("rank").alias("r3"), F.col("part").alias("p3"), "p_quota")
    per_shard = per_shard.drop("quota").join(per_part, (F.col("rank") == F.col("r3")) & (F.col("part") == F.col("p3"))).drop("r3", "p3")
    per_shard = sainte_lague(per_shard, ["rank", "part"], "s_size", "p_quota", [F.col("shard")], "s_quota").select(F.col("rank").alias("r2"), F.col("shard").alias("h2"), "s_size", "s_quota")
    docs = docs.withColumn("lo", F.sum("size").over(Window.partitionBy("rank", "shard").orderBy(F.md5("key"), "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    docs = docs.join(per_shard, (F.col("rank") == F.col("r2")) & (F.col("shard") == F.col("h2")))
    want = F.least(F.col("s_quota") * block_tokens, max_repeat * F.col("s_size"))
    some = F.greatest(F.col("s_size"), F.lit(1).cast("long"))
    docs = docs.withColumn("rounds", F.floor(want / some)).withColumn("rest", want % some).withColumn("blocks", F.ceil(some / block_tokens))
    drawn = _number(_seeded(seed, F.lit("order"), F.col("rank"), F.col("shard")))
    docs = docs.withColumn("step", F.element_at(F.array(*(F.lit(p).cast("long") for p in PRIMES)), (drawn % len(PRIMES) + 1).cast("int"))).withColumn("shift", F.floor(drawn / len(PRIMES)) % F.col("blocks"))
    return docs.withColumn("last", _order(F.col("blocks") - 1))


def _order(block: Column) -> Column:
    """When a block's turn comes."""
    return (F.col("step") * block + F.col("shift")) % F.col("blocks")


def _from_block(block: Column, block_tokens: int) -> Column:
    """Words that the rest of the quota takes from the start of a block: all blocks before it in order are taken first, the shard's last one holds fewer words."""
    short = F.col("blocks") * block_tokens - F.col("s_size")
    before = _order(block) * block_tokens - F.when(F.col("last") < _order(block), short).otherwise(0)
    return F.greatest(F.least(F.lit(block_tokens).cast("long"), F.col("rest") - before), F.lit(0).cast("long"))


def mixture(documents: DataFrame, seed: int = 17, block_tokens: int = 32, shard_tokens: int = 1_000_000, max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    d = _places(documents, seed, block_tokens, shard_tokens, max_repeat, id_col, text_col, source_col)
    lo, hi = F.col("lo"), F.col("lo") + F.col("size")
    own = F.sequence(F.floor(lo / block_tokens), F.floor((hi - 1) / block_tokens))

    def taken(block: Column) -> Column:
        start = block * block_tokens
        return F.greatest(F.least(hi, start + _from_block(block, block_tokens)) - F.greatest(lo, start), F.lit(0).cast("long"))

    part = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + taken(b))).otherwise(0)
    return d.select(F.col("k1").alias("doc_id"), "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))


def mix_documents(documents: DataFrame, seed: int = 17, block_tokens: int = 32, shard_tokens: int = 1_000_000, max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as mixed: whole documents, each as often as its first word is taken; the columns stay as they are. Of equal rows one stands for all."""
    d = _places(documents, seed, block_tokens, shard_tokens, max_repeat, id_col, text_col, source_col)
    block = F.floor(F.col("lo") / block_tokens)
    first = (F.col("lo") - block * block_tokens < _from_block(block, block_tokens)).cast("long")
    times = F.when(F.col("size") > 0, F.col("rounds") + first).otherwise(F.lit(0)).cast("int")
    d = d.select("k1", "k2", times.alias("times"))
    # equal rows share a key: their times are summed and given to one row of them
    d = materialise(d.groupBy(F.col("k1").alias("_m1"), F.col("k2").alias("_m2")).agg(F.sum("times").cast("int").alias("_times"), F.count(F.lit(1)).alias("_rows")).filter("_times > 0"))
    # whole rows travel as one struct, so that no column of theirs can clash with ours
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = documents.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), text.alias("_k2"))
    joined = rows.join(d.hint("merge"), F.col("_id").eqNullSafe(F.col("_m1")) & (F.col("_k2") == F.col("_m2")))
    alone = joined.filter("_rows = 1").select("_row", "_times")
    equal = joined.filter("_rows > 1").dropDuplicates(["_m1", "_m2"]).select("_row", "_times")
    return alone.unionAll(equal).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def oracle_sql(seed: int = 17, block_tokens: int = 32, shard_tokens: int = 1_000_000, max_repeat: int = 3) -> str:
    """The rows of :func:`mixture` in DuckDB's SQL, with every seat listed and ranked."""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id k1, md5(coalesce(text, '')) k2, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) rnk, CAST((SELECT sum(size) FROM docs) AS BIGINT) total FROM src),
weighed AS (SELECT *, (rnk - 1) % 3 + 1 weight, {max_repeat} * source_size cap FROM ranked),
levels AS (SELECT *, (total - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)) / CAST(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) level FROM weighed),
targets AS (SELECT source, source_size, rnk, total, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) target FROM levels),
seats AS (SELECT rnk, target / (2 * j + 1) qt FROM targets, range(CAST(ceil(target / {block_tokens}) AS BIGINT) + 2) r(j)),
won AS (SELECT rnk FROM seats ORDER BY qt DESC, rnk LIMIT (SELECT CAST(round(any_value(total) / {block_tokens}) AS BIGINT) FROM targets)),
quotas AS (SELECT t.source, t.source_size, t.target, t.rnk, (SELECT count(*) FROM won w WHERE w.rnk = t.rnk) quota, greatest(CAST(ceil(source_size / {shard_tokens}) AS BIGINT), 1) shards FROM targets t),
dealt AS (SELECT d.k1, d.k2, d.size, q.* EXCLUDE (source), '{seed}:' || coalesce(CAST(d.k1 AS VARCHAR), '') || ':' || d.k2 key FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
sharded AS (SELECT *, CAST('0x' || substr(md5('shard:' || key), 1, 8) AS BIGINT) % shards shard FROM dealt),
per AS (SELECT rnk, shard, shard // {GROUP} part, quota, CAST(sum(size) AS BIGINT) s_size FROM sharded GROUP BY ALL),
perp AS (SELECT rnk, part, quota, CAST(sum(s_size) AS BIGINT) p_size FROM per GROUP BY ALL),
pseats AS (SELECT rnk, part, quota, p_size / (2 * j + 1) qt FROM perp, range(quota + 1) r(j) WHERE p_size > 0),
pwon AS (SELECT rnk, part FROM pseats QUALIFY row_number() OVER (PARTITION BY rnk ORDER BY qt DESC, part) <= quota),
parts AS (SELECT p.rnk, p.part, (SELECT count(*) FROM pwon w WHERE w.rnk = p.rnk AND w.part = p.part) p_quota FROM perp p),
sseats AS (SELECT p.rnk, p.part, p.shard, q.p_quota, p.s_size / (2 * j + 1) qt FROM per p JOIN parts q ON p.rnk = q.rnk AND p.part = q.part, range(q.p_quota + 1) r(j) WHERE p.s_size > 0),
swon AS (SELECT rnk, shard FROM sseats QUALIFY row_number() OVER (PARTITION BY rnk, part ORDER BY qt DESC, shard) <= p_quota),
pers AS (SELECT p.rnk, p.shard, p.s_size, (SELECT count(*) FROM swon w WHERE w.rnk = p.rnk AND w.shard = p.shard) s_quota FROM per p),
drawn AS (SELECT *, least(s_quota * {block_tokens}, {max_repeat} * s_size) want, greatest(s_size, 1) some, CAST(ceil(greatest(s_size, 1) / {block_tokens}) AS BIGINT) blocks,
  CAST('0x' || substr(md5('{seed}:order:' || rnk || ':' || shard), 1, 8) AS BIGINT) draw FROM pers),
orders AS (SELECT *, want // some rounds, want % some rest, list_extract({list(PRIMES)}, CAST(draw % {len(PRIMES)} + 1 AS INT)) step, (draw // {len(PRIMES)}) % blocks shift FROM drawn),
places AS (SELECT s.k1, s.k2, s.size, s.source_size, s.target, o.*, (o.step * (o.blocks - 1) + o.shift) % o.blocks last_,
  CAST(sum(s.size) OVER (PARTITION BY s.rnk, s.shard ORDER BY md5(key), k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size lo
  FROM sharded s JOIN orders o ON s.rnk = o.rnk AND s.shard = o.shard),
turns AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(lo // {block_tokens}, (lo + size - 1) // {block_tokens} + 1) ELSE [-1] END) b FROM (SELECT row_number() OVER () id, * FROM places)),
cut AS (SELECT *, greatest(least({block_tokens}, rest - ((step * b + shift) % blocks * {block_tokens} - CASE WHEN last_ < (step * b + shift) % blocks THEN blocks * {block_tokens} - s_size ELSE 0 END)), 0) got FROM turns)
SELECT k1 doc_id, size, source_size, target, CAST(rounds * size + sum(CASE WHEN b < 0 THEN 0 ELSE greatest(least(lo + size, b * {block_tokens} + got) - greatest(lo, b * {block_tokens}), 0) END) AS BIGINT) taken
FROM cut GROUP BY id, k1, size, source_size, target, rounds"""
