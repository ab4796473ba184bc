from pyspark.sql import functions as F

import corpus_pipeline
from braidwork.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        if name == "line dedup":
            assert out.count() == docs.count()
        elif name != "mixing":
            assert 0.5 * n < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_names():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)


def test_stages_take_awkward_rows(spark):
    some = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    rows += [(900, None, "en", "src0", None), (901, "", None, "src0", 0), (902, " \n\n ", "en", None, 4), (None, "a b c\nd e f\ng h i", "de", "src1", 17), (903, "long words " * 30_000, "en", "src2", 330_000)]
    rows += [rows[0], rows[0], (904, rows[1][1], "en", "src0", 1), (905, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_lines", "epoch", "key", "component", "score", "_value", "shard", "h", "m", "fp"):
        docs = docs.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        kept = out.collect()
        assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < len(kept), name
        if name == "line dedup":
            assert len(kept) == len(rows) and sum(r.text is None for r in kept) == 2
        if name == "toxicity":
            assert sum(r.text is None for r in kept) == 2 and len({r.doc_id for r in kept if r.doc_id in (900, 901, 902, 903)}) == 4
        if name == "near-duplicates":
            assert sum(not (r.text or "").strip() for r in kept) == 1 and sum(r.doc_id == rows[0][0] for r in kept) == 3 and sum(r.doc_id is None for r in kept) == 1 and not any(r.doc_id == 904 for r in kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sum(r.doc_id == 900 for r in last) == 1 and sum(r.doc_id == rows[0][0] and r.piece == 0 for r in last) == 3
