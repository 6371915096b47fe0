import numpy as np
import random

import pytest
from latticelu.llm import common, langid
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))


def test_held_out_accuracy(fitted):
    docs, model = fitted
    rows = langid.identify(docs, model).filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.lang_score <= 1 for r in rows) and not any(r.lang_rejected for r in rows)


def test_chunks_count_like_the_whole(monkeypatch):
    text = "Ñandú, über-mäßig! x1y  the cat. " * 40
    whole = langid._counts(text)[0]
    monkeypatch.setattr(langid, "_CHUNK", 64)
    parts = langid._counts(text)[0]
    assert abs(whole - parts).sum() <= 0.02 * whole.sum()  # only blanks at the seams may differ


def test_several_centroids_a_language(fitted):
    assert fitted[1].languages.count("en") > 1


def test_rejects_other_scripts_and_letterless(spark, fitted):
    _, model = fitted
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 --- !!"), (4, "日本語の文章です" * 9)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].lang_score == 0 and got[k].lang_rejected for k in (1, 2, 3))
    assert got[4].lang_rejected


def test_nulls_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the cat", None, 1), (None, "the dog", "en", 2), (2, None, "en", 3)], "doc_id bigint, text string, lang string, lang_score int")
    model = langid.fit(df)
    assert set(model.languages) <= {"en"}
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"] and out.count() == 3
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_long_texts_of_unlearned_scripts_and_noise_are_rejected(fitted):
    _, model = fitted
    rng = random.Random(1)
    alphabets = {"Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "CJK": [chr(0x4E00 + k) for k in range(1024)], "noise": "abcdefghijklmnopqrstuvwxyz"}
    for name, letters in alphabets.items():
        for n in (30, 100, 500, 2000) if name != "noise" else (30, 100):
            text = " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))
            language, score, known = langid.classify(text, model)
            assert not known, (name, n, language, score)
    assert not langid.classify("Сегодня утром мы поехали за город и долго гуляли в лесу. Вечером все вернулись домой и пили чай.", model)[2]


def test_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aBcÉßΣ  .,1\nжİ")) for _ in range(n)) for n in (1, 2, 3, 10, 500)] + ["   ", " a", "a ", "x" * 50]
    whole = [langid._counts(t) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_CHUNK", size)
        for t, (counts, letter) in zip(texts, whole):
            got = langid._counts(t)
            assert (got[0] == counts).all() and got[1] == letter


def test_every_language_is_learned_and_too_many_are_an_error(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(9 * k + r, " ".join(letters[k % 26] + letters[(k // 26 + r) % 26] + letters[(7 * k) % 26] for _ in range(5)), f"l{k:03d}") for k in range(90) for r in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert set(langid.fit(df).languages) == {f"l{k:03d}" for k in range(90)}
    with pytest.raises(ValueError):
        langid.fit(df, max_languages=89)


def test_repeated_and_null_ids_stay_within_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "materialize", lambda df, name: seen.append(materialized := common.materialize(df, name)) or materialized)
    rows = [(7, f"the cat sat on mat {k}", "en") for k in range(500)] + [(None, "le chat noir", "fr")] * 300 + [(8, "der hund", "de"), (7, "der hund bellt", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=3)
    assert set(model.languages) == {"en", "fr", "de"}
    assert sorted((r.id is None, r.id, r.label) for r in seen[0].filter("id is not null").collect()) == [(False, 7, "de"), (False, 7, "en"), (False, 8, "de")]
    assert seen[0].filter("id is null").count() == 1
