"""The registered queries over the smallest test tables: columns, row counts, and SQL where there is some."""

import os

import duckdb
import pytest

from strandline.llm import queries as Q

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")

COLUMNS = {
    "op1_suffix_dedup": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "op2_packing": "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    "op3_secret_scan": "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    "op4_jaccard_join": "doc_id long, class_id long, n_links long",
    "op5_language": "doc_id long, held_out boolean, lang_pred string, score double",
    "op6_quality": "doc_id long, held_out boolean, score double, predicted int",
    "op7_vector_dedup": "vec_id long, n_links long, component_id long, kept boolean",
    "op8_mixing": "doc_id long, size long, source_size long, target double, taken long",
    "op9_fingerprints": "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_token_counts": "doc_id long, section int, n_tokens long, doc_tokens long",
}
KINDS = {"long": "bigint"}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    df = Q.queries()[name](spark, D)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        column, kind = c.split(" ")
        assert kinds[column] == KINDS.get(kind, kind), column
    source = spark.read.parquet(f"{D}/{'embeddings' if name.startswith('op7') else 'documents'}.parquet")
    key = "vec_id" if name.startswith("op7") else "doc_id"
    rows = df.collect()
    assert {r[key] for r in rows} == {r[0] for r in source.select(key).collect()}
    if name not in ("op2_packing", "op10_token_counts"):
        assert len(rows) == source.count()
    if name in Q.oracle_sql():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
        cursor = con.execute(Q.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


def test_bounded_sample(spark):
    from pyspark.sql import functions as F

    from strandline.llm._common import hashed_sample

    df = spark.range(5000).repartition(7)
    a, b = (sorted(r.id for r in hashed_sample(x, 20, F.xxhash64("id"), "id").collect()) for x in (df, df.repartition(3)))
    least = sorted(df.select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("h")).collect(), key=lambda r: r.h)[:20]
    assert a == b == sorted(r.id for r in least)
