import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_act(spark, tmp_path):
    good = [(i, f"the river {i} runs over stone {i * 7} and under the old bridge {i * 3} toward the sea", "en", f"s{i % 3}", 1) for i in range(60)]
    rows = good + [(100, good[0][1], "en", "s0", 1), (101, None, "en", "s1", 1), (102, "123 !!", None, None, 1), (103, "", "en", "s1", 1)]
    rows += [(200 + i, " ".join(f"word{i}%%%" for _ in range(20)), "en", "s2", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen.append({r[0] for r in kept.select("doc_id").collect()})
    assert not seen[0] & {101, 102, 103} and seen[0] >= set(range(61)) - {60}
    assert not seen[1] & set(range(200, 220)) and seen[1] >= set(range(60))
    assert 100 not in seen[2] and seen[2] == set(range(60))
    assert seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == kept.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, mark string, quality string, times string, copy string"


def test_join_stage_tells_texts_apart_by_more_than_their_id(spark, tmp_path):
    story = "the river runs over stone and under the old bridge toward the sea"
    rows = [(1, story, "a"), (1, "another text of more than five words in all", "b"), (2, story, "c"), (None, story, "d"), (None, "a text that has no number but many words", "e")]
    rows += [(None, "a text that has no number but many words", "e"), (7, None, "f"), (8, "", "g"), (1, story, "a"), (2**60 + 1, "large numbers stay whole beside rows that have none", "h")]
    docs = spark.createDataFrame([(i, t, "en", None, None, m, m, m, m) for i, t, m in rows], ODD)
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["mark"]) for r in got.collect()), key=str) == sorted({rows[0], rows[1], rows[4], rows[6], rows[7], rows[9]}, key=str)
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"], r["times"], r["copy"]) for r in mixed} == {(i, t, m, m) for i, t, m in rows if t}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], ODD)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
