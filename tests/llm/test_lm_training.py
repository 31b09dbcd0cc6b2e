"""Every training document is trained on, in runs of bounded bytes."""

import numpy as np
import pyarrow as pa

from verdictlake.llm import lm_scoring, recurrent


def test_runs_hold_all_texts_whole():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c", "d" * 35, "e"])
    runs = list(lm_scoring.runs_of(texts, 40))
    assert [t for run in runs for t in run.to_pylist()] == texts.to_pylist()
    assert len(runs) > 1
    assert list(lm_scoring.runs_of(pa.array([], pa.string()), 40)) == []


def test_all_training_documents_are_trained_on(spark, monkeypatch):
    rows = [(k, f"word{k} and some other words {k % 7}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    seen = []
    averaged = lm_scoring._averaged
    monkeypatch.setattr(lm_scoring, "_averaged", lambda model, sums, texts: seen.append(texts.count()) or averaged(model, sums, texts))
    lm_scoring.fit(docs)
    assert seen == [docs.filter(~lm_scoring.held_out("doc_id")).count()]


def test_words_become_tokens_together():
    """Head words by their place, all others by the class of their last two characters, as each alone."""
    head = recurrent.make_head([("the", 9), ("é", 8), ("ab", 7)], 3, lm_scoring.ENDINGS, 2)
    model = lm_scoring.Model(head, 3, 24, 3, np.ones(lm_scoring.ENDINGS), np.ones(lm_scoring.ENDINGS), np.zeros(0))
    words = ["ab", "x", "the", "日本語", "then", "é", "è", "naïvé", "a\u0301", "𝄞𝄞𝄞"]
    place = {w: 1 + k for k, w in enumerate(head.words)}
    want = [place.get(w) or head.size + recurrent.ending_class(w, head.endings) for w in words]
    assert model.tokens_of(pa.array(words)).tolist() == want
    assert model.tokens_of(pa.array([], pa.string())).tolist() == []


def test_softmax_in_place_by_runs_of_rows():
    rng = np.random.default_rng(3)
    logits, own = rng.normal(size=(50, 7)) * 5, rng.integers(0, 7, 50)
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    for rows in (1, 16, 50):
        less, found = recurrent.Network._softmax(logits.copy(), own, rows)
        np.testing.assert_allclose(less, p - np.eye(7)[own], atol=1e-12)
        np.testing.assert_allclose(found, np.log(p[np.arange(50), own]), atol=1e-12)
