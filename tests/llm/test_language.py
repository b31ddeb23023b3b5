"""Language ID: rejection, the sample, names of columns."""

import random

import numpy as np
import pytest
from nearfield.llm import catalogue, langid
from pyspark.sql import functions as F

FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.held_out())


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_foreign_texts_are_rejected_and_clean_ones_stay(spark, docs, model):
    r = random.Random(1)
    letters = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60))
    for text in [*FOREIGN.values(), letters]:
        assert model.predict(text)[3]
    kept = langid.known_only(docs, model)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert kept.count() == lettered.count() and kept.columns == docs.columns
    assert langid.known_only(spark.createDataFrame([(1, FOREIGN["pl"]), (2, "12 + 3"), (3, None)], "doc_id long, text string"), model).collect() == []


def test_held_out_accuracy_of_the_query(spark, docs):
    truth = {x["doc_id"]: x["lang"] for x in docs.collect()}
    rows = catalogue.op8_language(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(truth[x["doc_id"]] == x["lang_pred"] for x in rows if truth[x["doc_id"]]) >= 0.99 * sum(truth[x["doc_id"]] is not None for x in rows)
    assert all(0 <= x["score"] <= 1 for x in rows)


def test_sample_is_bounded_and_shuffles_no_texts(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("lang"))
    sample = langid.sampled(rows, 500)
    by = {x["lang"]: x["count"] for x in sample.groupBy("lang").count().collect()}
    assert all(400 < by[lang] < 600 for lang in "ab")
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not any("text" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_calibration_bounds():
    counts = {"a": np.full(langid.SIZE, 5), "b": np.arange(langid.SIZE)}
    model = langid.calibrated(langid.train(counts), [("a", 40, 1000), ("a", 0, 10), ("a", 3, 3)])
    assert 0 <= model.bound[0] < 0.2 and model.bound[0] == model.bound[1]
    assert langid.calibrated(langid.train(counts), []).bound.tolist() == [1.0, 1.0]


def test_slices_see_the_whole_text(docs, model, monkeypatch):
    text = " ".join(x["text"] for x in docs.where("lang = 'fr'").limit(20).collect())
    whole = model.predict(text)
    monkeypatch.setattr(langid, "SLICE", 1000)
    parts = model.predict(text)
    assert parts[0] == whole[0] and parts[3] == whole[3] and parts[4] == pytest.approx(whole[4], rel=0.02)


def test_columns_may_have_any_name(spark, model):
    names = ["lang_pred", "score", "foreign", "ambiguous", "margins", "a b", "x`y", "_0", "_text", "doc_id", "text"]
    rows = spark.createDataFrame([tuple(str(i) for i in range(len(names) - 1)) + (FOREIGN["pl"],)], ", ".join("`" + c.replace("`", "``") + "` string" for c in names))
    assert langid.known_only(rows, model).columns == names
    assert [tuple(x)[:4] for x in langid.identify(rows, model, keep=("a b", "x`y", "_text", "text")).collect()] == [("5", "6", "8", FOREIGN["pl"])]
    assert langid.identify(rows, model, keep=("score", "a b")).columns == ["a b", *langid.RESULTS]
