import numpy as np
import public_tokenizers as P
import random

from pyspark.sql import functions as F

from sunledger.llm import langid as L

from .conftest import ODD

MODEL = P.path("piece_bpe_32k.model")


def test_sum_over_all_segmentations():
    with open(MODEL, "rb") as f:
        pieces = L.Pieces(f.read())
    p = np.random.default_rng(1).random((len(pieces.pieces) + 1, 2))
    p /= p.sum(axis=0)

    def brute(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2) if pieces.row.get(text[0]) else p[0] * brute(text[1:])
        for j in range(1, len(text) + 1):
            if pieces.row.get(text[:j]):
                out = out + p[pieces.row[text[:j]]] * brute(text[j:])
        return out

    words = ["the", "über", "日本", "international", "a日b", "x" * 12]
    scorer = L.Scorer(pieces, L.Model(["a", "b"], p))
    assert np.allclose(scorer.score_words(words), [np.log(brute("▁" + w)) for w in words])
    long = ["ab" * 60, "z" * 39, "z" * 45]
    assert np.allclose(scorer.score_words(long)[1], L.forward(pieces.steps(long[1]), 40, p))
    assert np.isfinite(scorer.score_words(long)).all()


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    of = {"en": "the of and to in that is was for with", "fr": "le la les de des et une que pour dans", "de": "der die das und ist nicht ein mit"}
    rows = [(i, " ".join(rng.choices(of[lang].split(), k=8)), lang) for i in range(150) for lang in [rng.choice(list(of))]]
    out = {r.doc_id: r for r in L.predict_languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
    held = [(out[i].lang_pred == lang) for i, _, lang in rows if out[i].held_out]
    assert len(held) > 20 and all(held) and all(0 <= r.score <= 1 for r in out.values())


def test_odd_rows(spark, documents):
    out = L.predict_languages(spark, documents(ODD), MODEL).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    unlabelled = documents(ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.predict_languages(spark, unlabelled, MODEL).collect()} == {"und"}
    assert L.predict_languages(spark, documents([]), MODEL).count() == 0


def test_long_words_teach_and_are_scored(spark):
    with open(MODEL, "rb") as f:
        pieces = L.Pieces(f.read())
    p = np.random.default_rng(2).random(len(pieces.pieces) + 1) * 1e-3
    word = "internationalization" * 2 + "日本"
    edges, n = pieces.steps(word), len(word) + 1
    # A piece's expected count is the derivative of the log-probability by the log of its p.
    for row, x in L.expected_counts(edges, n, p.tolist()).items():
        up, down = p.copy(), p.copy()
        up[row] *= 1 + 1e-5
        down[row] *= 1 - 1e-5
        assert np.isclose(x, (L.forward(edges, n, up[:, None]) - L.forward(edges, n, down[:, None]))[0] / 2e-5, atol=1e-5)
    unknown = "\ue000" * 3000      # no piece holds it
    assert np.isclose(L.forward(pieces.steps(unknown), 3001, p[:, None])[0], np.log(p[pieces.row["▁"]] * 1.0) + 3000 * np.log(p[0]))

    rng = random.Random(3)
    of = {"ja": "のにをはがとでもあい", "zh": "的一是不了人我在有他", "en": ["the ", "of ", "and ", "to ", "in "]}
    rows = [(i, "".join(rng.choices(of[lang], k=rng.randint(45, 300))), lang) for i in range(120) for lang in [rng.choice(list(of))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.train(spark, docs, MODEL).languages == ["en", "ja", "zh"]
    out = {r.doc_id: r for r in L.predict_languages(spark, docs, MODEL).collect()}
    held = [(out[i].lang_pred == lang) for i, _, lang in rows if out[i].held_out]
    assert len(held) > 20 and all(held)
