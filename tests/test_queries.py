import math
import os

import pytest

import __spark_entry__ as entry
from seqgrove import queries as own

duckdb = pytest.importorskip("duckdb")
SLOW = {"q19_motif_features", "q20_motif_matches"}


def canonical(df):
    def one(v):
        if v is None or str(v) in ("<NA>", "nan", "None"):
            return "NULL"
        return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_its_sql(spark, sf, db, name):
    got = own.QUERIES[name](spark, sf).toPandas()
    sql = own.sql().get(name)
    if sql is None:
        assert len(got) or name not in ("q16_signatures", "q31_linkage", "q32_communities")
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["query", "rank", "terms", "cluster_ids", "weight", "description"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_and_files_grow_with_the_rows(spark, sf, monkeypatch):
    """Limits of a few rows stand for large tables: profiles stay in many partitions, records in many files, with the same results."""
    from seqgrove import storage, text_queries
    from seqgrove.operators import ontology
    from seqgrove.plans import driver_tables as T

    def rows():
        own = ontology.propagated(T.order_profiles(spark, sf), ontology.reflexive(*(f(spark) for f in (lambda s: T.ontology_p(s, sf)[0], lambda s: ontology.closure(T.ontology_p(s, sf)[1])))))
        return own, sorted(map(tuple, own.collect())), sorted(map(tuple, text_queries.q37_profile_file(spark, sf).collect()))

    _, *want = rows()
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    monkeypatch.setattr(text_queries, "FILE_ROWS", 100)
    own, *got = rows()
    assert got == want and own.rdd.getNumPartitions() >= 6_000 // 500
    path = text_queries.written(spark, spark.range(1000).selectExpr("cast(id as string) as value"), rows=1000)
    assert spark.read.text(path).count() == 1000 and spark.read.text(path).selectExpr("_metadata.file_path as f").distinct().count() == 10


def test_a_file_is_written_by_one_task(spark, monkeypatch):
    import re

    from seqgrove import text_queries

    monkeypatch.setattr(text_queries, "FILE_ROWS", 100)
    for head in (None, "head"):
        path = text_queries.written(spark, spark.range(2000).selectExpr("cast(id as string) as value"), head=head, rows=2000)
        files = [r.f for r in spark.read.text(path).selectExpr("_metadata.file_path as f").distinct().collect()]
        assert len(files) == 20 and len({re.search(r"part-(\d+)", f).group(1) for f in files}) == 20
        assert spark.read.text(path).where("value <> 'head'").count() == 2000
        assert head is None or {r.value for r in spark.read.text(path).where("value = 'head'").collect()} == {"head"}
    rows = spark.range(40).selectExpr("concat('x', id) as value", "cast(id % 4 as string) as key", "cast(40 - id as int) as ord")
    back = [r.value for r in spark.read.text(text_queries.written(spark, rows)).collect()]
    assert sorted(back) == sorted(f"x{i}" for i in range(40)) and all([v for v in back if int(v[1:]) % 4 == k] == [f"x{i}" for i in range(39, -1, -1) if i % 4 == k] for k in range(4))
