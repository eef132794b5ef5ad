"""Operators that SQL can express, against it; and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, files, mixing, quality_model, quality_rules, registry, warc
from tessera.llm.common import table
from tests.oracle import connection, same

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], connection(sf))


def test_names_follow_the_list():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in names


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, " \n ", "xx", "a"), (4, "word " * 9000, "en", "b"), (4, "word " * 9000, "en", "b"), (None, "one two", "fr", "b"), (6, " 　 é", "fr", None)]


@pytest.mark.parametrize("name", ["op2_mix_sources", "op10_quality_rules"])
def test_odd_rows_against_sql(spark, tmp_path, name):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(str(tmp_path / "x"))
    folder = tmp_path / "in"
    folder.mkdir()
    next((tmp_path / "x").glob("part*")).rename(folder / "documents.parquet") if len(list((tmp_path / "x").glob("part*"))) == 1 else spark.createDataFrame(ODD, SCHEMA).toPandas().astype({"doc_id": "Int64"}).to_parquet(folder / "documents.parquet")
    got = registry.queries()[name](spark, str(folder))
    if name == "op2_mix_sources":  # repeated rows may swap copies
        got = got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))
        con = connection(str(folder))
        sql = f"SELECT doc_id, size, source_size, round(target, 6) AS target FROM ({registry.oracle_sql()[name]})"
        same(got, sql, con)
    else:
        same(got, registry.oracle_sql()[name], connection(str(folder)))


# ---- mixing ----


def test_sources_come_near_their_targets(spark, sf):
    out = mixing.op2_mix_sources(spark, sf).collect()
    by = {}
    for r in out:
        by.setdefault((r["target"], r["source_size"]), []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for (target, _), rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows) + 1e-6


def test_emitted_rows_are_the_copies(spark, sf):
    d = table(spark, sf, "documents")
    n = mixing.op2_mix_sources(spark, sf).agg(F.sum("copies")).first()[0]
    out = mixing.emit(d)
    assert out.columns == d.columns and out.count() == n


def test_mixing_of_no_rows_and_clashing_names(spark):
    d = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("lang", "Target").withColumn("mix_at", F.lit(1))
    assert mixing.emit(d).columns == d.columns
    assert mixing.emit(d.limit(0)).count() == 0


# ---- decontamination ----


def test_passages_are_found_despite_replaced_words(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    swapped = list(words)
    for i in (3, 11, 19, 27, 35):
        swapped[i] = "other"
    rows = [(1, "before " * 30 + item.upper() + " after" * 30), (2, "x " + " ".join(swapped) + "."), (3, "unrelated " * 50), (4, " ".join(words[:7])), (5, None), (6, "")]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)
    items = spark.createDataFrame([(7, item), (8, "short one"), (9, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, items).collect()} == {(1, 7), (2, 7)}
    kept = decontamination.keep_clean(d.withColumn("text_key", F.lit("own")), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and "text_key" in kept.columns
    assert decontamination.leaks(d, items.limit(0)).count() == 0 and decontamination.leaks(d.limit(0), items).count() == 0


def test_beyond_the_bound_both_sides_are_shuffled(spark, sf, monkeypatch):
    want = sorted(map(tuple, decontamination.op3_decontamination(spark, sf).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, decontamination.op3_decontamination(spark, sf).collect())) == want


# ---- quality ----


def test_rules_keep_clashing_columns_and_no_rows(spark):
    d = spark.createDataFrame(ODD, SCHEMA).withColumn("qr_words", F.lit(3)).withColumn("KEPT", F.lit("x"))
    out = quality_rules.judge(d)
    assert "qr_words" in out.columns and out.count() == len(ODD)
    assert quality_rules.judge(d.limit(0)).count() == 0


def test_rules_keep_documents_of_any_language(spark, sf):
    """Clean texts of unlisted languages stay, junk that names one goes, and no other verdict changes."""
    r = random.Random(3)
    letters = {"xa": "aeioklmnprstvu", "xb": "абвгдеиклмнопрст"}
    rows = []
    for lang, of in letters.items():
        w = ["".join(r.choice(of) for _ in range(r.randrange(2, 9))) for _ in range(2000)]
        for i in range(40):
            rows.append((f"{lang}{i}", " ".join(r.choices(w, [1 / (k + 1) for k in range(len(w))], k=300)).capitalize() + ".", lang))
        rows.append((f"{lang}junk", " ".join("".join(r.choice("#$%0123456789ABCDEFX") for _ in range(6)) for _ in range(300)), lang))
    given = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    plain = {x["doc_id"]: x["kept"] for x in quality_rules.judge(given).collect()}
    for corpus in (spark.createDataFrame(rows, given.schema), given.unionByName(spark.createDataFrame(rows, given.schema)).repartition(4)):
        out = quality_rules.judge(corpus)
        assert out.columns[:3] == ["doc_id", "text", "lang"]
        kept = {x["doc_id"]: x["kept"] for x in out.collect()}
        assert {k for k, _, _ in rows if not kept[k]} == {"xajunk", "xbjunk"}
    assert {k: kept[k] for k in plain} == plain


def test_model_of_odd_rows(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality_model.classify(d, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["quality_score"] <= 1 for r in out)
    assert {round(r["quality_score"], 6) for r in quality_model.classify(d, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(d.limit(0), labels).count() == 0


def test_model_ranks_labelled_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = quality_model.op4_quality_model(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    good = [r["quality_score"] for r in rows if r["quality"] == 1]
    bad = [r["quality_score"] for r in rows if r["quality"] == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.8


# ---- WARC ----

PAGES = "page_id long, url string, html string"


def test_archives_give_back_every_payload(spark, sf):
    p = table(spark, sf, "pages")
    want = {r["page_id"]: (r["html"] or "").encode() for r in p.collect()}
    got = warc.read(warc.write(p)).collect()
    assert sorted(r["page_id"] for r in got) == sorted(want)
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == want[r["page_id"]]
        else:
            assert want[r["refers_to"]] == want[r["page_id"]]


def test_revisits_and_odd_pages(spark):
    long, short = "é" * 600, "y" * 999
    rows = [(1, "u", long), (2, None, long), (3, "a\nb", long), (4, "u", short), (5, "u", short), (6, "u", None), (None, "u", "z"), (7, "u", "")]
    d = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(0)).repartition(3)
    index = warc.write(d, most=200)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(index).collect()}
    assert got == {1: ("revisit", 3, 1200), 2: ("revisit", 3, 1200), 3: ("response", None, 1200), 4: ("response", None, 999), 5: ("response", None, 999), 6: ("response", None, 0), None: ("response", None, 1), 7: ("response", None, 0)}
    chosen = warc.read(index.where("page_id IN (3, 7)")).collect()
    assert sorted(r["page_id"] for r in chosen) == [3, 7]
    assert warc.read(warc.write(d.limit(0))).count() == 0


def test_ranges_are_read_together(tmp_path):
    uri, out = files.create(f"file://{tmp_path}", "x", ".bin")
    with out:
        out.write(bytes(range(200)))
    places = [(uri, 0, 10), (uri, 10, 5), (uri, 100, 20), (uri, 199, 1)]
    for gap, most in ((0, 1 << 20), (1000, 1 << 20), (1000, 12)):
        assert list(files.read_ranges(places, gap, most)) == [bytes(range(200))[o : o + n] for _, o, n in places]


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a/b?x=%0A", "http://a/b\r\nc%0D%25", "\n", "", None]
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert [r["url"] for r in warc.read(warc.write(d)).orderBy("page_id").collect()] == urls
