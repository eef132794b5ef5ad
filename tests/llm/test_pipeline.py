"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline
from tessera.llm import decontamination, mixing, quality_rules
from tessera.llm.common import table
from tests.llm.test_brute import brute_near, brute_tokens


def test_stages_agree_with_what_they_stand_for(spark, sf, tmp_path):
    docs, kept = table(spark, sf, "documents"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        kept.append(len(ids))
        if k == 0:
            assert ids == sorted(r["doc_id"] for r in quality_rules.judge(before).where("kept").collect())
        elif k == 1:
            assert ids == sorted({c for _, _, c in brute_near(rows)})
        elif k == 2:
            gone = {r["doc_id"] for r in decontamination.leaks(before, table(spark, sf, "benchmark")).collect()}
            assert gone and ids == sorted(i for i, _ in rows if i not in gone)
        elif k == 3:
            assert len(ids) == mixing.emit(before).count() and set(ids) <= {i for i, _ in rows}
        else:
            assert sorted(map(tuple, docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == brute_tokens(rows)
    assert kept[0] > 0.5 * table(spark, sf, "documents").count()
    again = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert again == sorted(map(tuple, docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()))


def test_stages_of_odd_and_no_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x " * 5000, "en", None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, d, sf).collect()
        assert stage(spark, d.limit(0), sf).count() == 0
