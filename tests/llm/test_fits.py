"""The learned operators' fits: texts stay in the tasks, and the models are those of plain fits."""

import random

import numpy as np

from blocklens.llm import langid, toxicity


def table(spark, n=90):
    """Texts of some 50,000 characters in two languages; every third is toxic."""
    pick = random.Random(3)
    words = {"en": "the water house over there and with some light".split(), "fr": "le chien dans une maison avec nous pour toujours".split()}
    rows = []
    for i in range(n):
        lang, toxic = ("en", "fr")[i % 2], int(i % 3 == 0)
        text = " ".join(pick.choices(words[lang] + ["zorgfel"] * toxic, k=9_000)) + "."
        rows.append((i, text, lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)


def test_fits_leave_the_texts_in_the_tasks(spark, monkeypatch):
    df = table(spark).cache()
    total, plain, fetched = sum(len(r[0]) for r in df.select("text").collect()), type(df).collect, []

    def collect(self):
        got = plain(self)
        fetched.append(sum(len(v) for r in got for v in r if isinstance(v, (str, bytes, bytearray))))
        return got

    monkeypatch.setattr(type(df), "collect", collect)
    langid.fit(df)
    assert fetched and sum(fetched) < total / 20
    fetched.clear()
    toxicity.fit(df, df.select("doc_id", "toxic"))
    assert fetched and sum(fetched) < total / 20


def test_toxicity_fit_equals_the_plain_one(spark):
    df = table(spark)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    rows = df.where(~toxicity.held_out("doc_id")).orderBy("doc_id").collect()
    plain = toxicity.Toxicity([(r.text, r.toxic) for r in rows])
    assert "zorgfel" in model.words and (model.words, model.starts) == (plain.words, plain.starts)
    assert np.array_equal(model.weights, plain.weights)


def test_language_weights_equal_those_of_whole_vectors(spark):
    rows = table(spark, 600).selectExpr("substr(text, 1, 40 + doc_id) text", "lang").collect()  # more than a slab
    model = langid.Hierarchy([r.text for r in rows], [r.lang for r in rows])
    x = np.array([np.append(langid.features(r.text), 1) for r in rows], "float32")

    def svm(y, cost=10.0, rounds=80):
        each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        w = v = np.zeros(x.shape[1])
        for k in range(rounds):
            new = v - (v - 2 * cost * (x.T @ (each * y * np.maximum(0, 1 - y * (x @ v))))) / (4 * cost + 1)
            v, w = new + (k / (k + 3)) * (new - w), new
        return w

    names = ["germanic", "romance"]
    assert model.names == names
    for name, got in zip(names, model.top):
        own = np.array([langid.FAMILY_OF[r.lang] == name for r in rows])
        assert np.abs(got - svm(np.where(own, 1.0, -1.0))).max() < 1e-4
    share = (x[[r.lang == "fr" for r in rows], :-1].astype(float) ** 2).sum(0)
    assert np.allclose(model.likely["fr"], np.log((share / share.sum() * langid.FEATURES + langid.ANY) / (1 + langid.ANY)), atol=1e-4)
