import corpus_pipeline
from cairn.llm.common import written


def through(spark, docs, sf, upto):
    for name, stage in corpus_pipeline.STAGES[:upto]:
        docs = written(stage(spark, docs, sf), name)
    return docs


def test_stages_keep_columns_and_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), name)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        assert after.count() <= before.count() and after.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert before.count() > 0.6 * docs.count()
    last = corpus_pipeline.run(spark, sf)
    pieces = last.groupBy("doc_id").agg({"length": "sum"}).count()
    assert pieces == before.select("doc_id").distinct().count()


def test_copies_nulls_and_clashing_columns(spark, sf):
    text = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, text, "en", "s", 5, "a"), (1, text, "en", "s", 5, "a"), (2, text, None, None, None, None), (3, None, "en", "s", 0, "b"), (None, text + " Mail a.b@c.org now.", "en", "s", 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    out = through(spark, docs, sf, 4).collect()
    assert {r.doc_id for r in out} <= {1, None} and [r.doc_id for r in out].count(1) == 1
    assert all("a.b@c.org" not in r.text for r in out) and out[0].asDict().keys() == {*docs.columns}
    assert through(spark, docs.limit(0), sf, 5).count() == 0


def test_a_second_run_leaves_the_first_ones_rows(spark, sf):
    first = corpus_pipeline.run(spark, sf)
    n = first.count()
    second = corpus_pipeline.run(spark, sf)
    assert first.count() == second.count() == n
    both = [{tuple(r) for r in x.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").collect()} for x in (first, second)]
    assert both[0] == both[1]


def test_a_very_long_text_goes_through(spark, sf):
    text = " ".join(f"word{i % 7919} and so on {i}." for i in range(40_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text + " end", "en", "s", len(text) + 4)], "doc_id long, text string, lang string, source string, n_chars long")
    out = through(spark, docs, sf, 5)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {1} and out.count() > 50
