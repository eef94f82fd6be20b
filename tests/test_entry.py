import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


#: Queries that SQL can't express, and the tests that hold their operators against plain Python.
BRUTE_FORCE = {
    "fuzzy_names": "test_fuzzy_edges_miss_no_alike_address",
    "visible_page_text": "test_visible_text_equals_a_plain_parser",
    "score_breakdown": "test_score_full_sparse_and_wrong_region",
    "export_rows": "test_export_rows_hold_every_field",
}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v if v is None else str(v)
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert f"def {BRUTE_FORCE[name]}(" in (ROOT / "tests/test_operators.py").read_text()
        return
    assert got, "a query that returns nothing compares nothing"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows_of(rel.columns, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_imports_without_the_optional_parts():
    code = "import sys; sys.modules['quarrymark.llm'] = None; import quarrymark.plans.search, quarrymark.plans.catalogue, quarrymark.streaming.pages; assert not [m for m in sys.modules if m.startswith('quarrymark.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_stream_windows(spark, sf_dir, tmp_path):
    from quarrymark.streaming import pages as streams

    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    q = streams.window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streams.window_counts(spark.read.parquet(str(source)))
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == batch.agg({"n": "sum"}).first()[0]
