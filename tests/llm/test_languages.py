"""Every language of the input is learned, however many there are."""

import random

from lectern.llm import langid


def corpus(spark, languages, each):
    rng, rows = random.Random(4), []
    for k in range(languages):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(60)), f"l{k:03d}") for i in range(each + (k < 64))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_more_than_64_languages_are_all_learned(spark):
    docs = corpus(spark, 70, 12)
    model = langid.fit(docs)
    assert set(model.langs) == {f"l{k:03d}" for k in range(70)}
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99 and set(got.lang_pred) == set(model.langs)


def test_no_language_goes_without_a_row(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_ROWS", 1)
    monkeypatch.setattr(langid, "LEAST_ROWS", 0)
    assert len(set(langid.fit(corpus(spark, 20, 12)).langs)) == 20
