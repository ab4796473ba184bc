import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r.n_kmers for r in rows) > 0


SMALL = "/root/testdata/sf0.001"


def same_rows(spark, names):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names:
        got = sorted(map(str, (tuple(r) for r in queries[name](spark, SMALL).collect())))
        assert got and got == sorted(map(str, con.execute(sql[name]).fetchall())), name


def test_whole_sets_count_all_languages(spark):
    queries = entry.queries()
    total = lambda name: queries[name](spark, SMALL).agg(F.sum("n_kmers")).first()[0]
    assert total("whole_histogram") > total("histogram")
    assert {"whole_" + n for n in ("dump", "info", "check", "sort", "kmer_functions", "read_counters", "mask_reads")} <= set(queries)
    same_rows(spark, ["whole_histogram", "whole_info", "whole_check", "whole_reduce", "whole_valid_windows"])


def test_uncut_texts_lose_no_window(spark):
    queries = entry.queries()
    total = lambda name, column: queries[name](spark, SMALL).agg(F.sum(column)).first()[0]
    assert total("uncut_count_by_signature", "cnt") == total("count", "cnt") > total("count_by_signature", "cnt")
    same_rows(spark, ["uncut_count_by_signature", "uncut_signatures", "uncut_super_kmers", "uncut_signature_statistics"])
