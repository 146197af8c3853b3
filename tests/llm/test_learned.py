import random
import zlib

import numpy as np
from common import documents, prose
from pyspark.sql import functions as F

from rayscape.llm import quality, toxicity


def labelled(n=600, seed=4):
    rng = random.Random(seed)
    texts, toxic, good = [], [], []
    for i in range(n):
        t = prose(rng, rng.randrange(10, 80), 3000)
        bad = i % 5 == 0
        if bad:
            t += " you rotten vermin " + prose(rng, 5)
        if i % 4 == 0:
            t += " a muslim woman spoke"
        junk = i % 7 == 0
        texts.append(" ".join(w + "%%%" for w in t.split()) if junk else t)
        toxic.append(int(bad))
        good.append(int(not junk))
    return texts, toxic, good


def labels(spark, toxic, good):
    rows = [(i, q, t) for i, (t, q) in enumerate(zip(toxic, good))] + [(None, 1, 1), (3, None, None), (10**6, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    texts, toxic, good = labelled()
    docs = documents(spark, [*texts, None, ""], [*range(600), None, 777])
    for rows, want, least in ((toxicity.classify(docs, labels(spark, toxic, good)).collect(), toxic, 0.99), (quality.classify(docs, labels(spark, toxic, good)).collect(), good, 0.99)):
        by = {r.doc_id: r for r in rows}
        assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows) and by[None].held_out
        held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
        assert {i for i in range(600) if by[i].held_out} == set(held)
        assert np.mean([by[i].predicted == want[i] for i in held]) >= least
        assert by[None].score == by[777].score


def test_labels_of_held_out_rows_are_never_read(spark):
    texts, toxic, good = labelled()
    flipped = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    docs = documents(spark, texts)
    one, other = (sorted((r.doc_id, r.score) for r in toxicity.classify(docs, labels(spark, t, good)).collect()) for t in (toxic, flipped))
    assert one == other


def test_counterfactuals_even_out_terms(spark):
    """A term that stands in toxic sentences only by chance of the sample hardly counts; the insult does."""
    texts, toxic = [], []
    for i in range(400):
        bad = i % 2
        who = "muslim" if bad else "christian"
        texts.append(f"the {who} neighbour is {'vermin' if bad else 'kind'} they say {i}")
        toxic.append(bad)
    model = toxicity.train(documents(spark, texts), labels(spark, toxic, toxic))
    gap = abs(model.score("a muslim neighbour") - model.score("a christian neighbour"))
    assert gap < 0.1 and model.score("vermin") - model.score("kind") > 0.5
    assert model.n_swaps > 0
    free = toxicity.train(documents(spark, texts), labels(spark, toxic, toxic), penalty=0.0)
    assert abs(free.score("a muslim neighbour") - free.score("a christian neighbour")) > 2 * gap  # so the penalty is what evens them out
    assert {b for _, b in toxicity.swaps("A gay man.")} >= {"a lesbian man", "a gay woman"}


def test_toxicity_of_odd_texts(spark):
    """Long texts, ties, repeated rows and clashing column names are scored like any others."""
    texts, toxic, good = labelled(200)
    odd = [texts[0], texts[0], None, "", " " * 500_000, "you vermin " * 100_000, "x" * 1_000_000]
    docs = documents(spark, [*texts, *odd]).withColumns({"score": F.lit(1), "predicted": F.lit(2), "held_out": F.lit("h"), "__text": F.lit("t")})
    rows = {r.doc_id: r.score for r in toxicity.classify(docs, labels(spark, toxic, good)).collect()}
    assert len(rows) == len(texts) + len(odd) and rows[0] == rows[200] == rows[201] and rows[202] == rows[203] == rows[204] and rows[205] > rows[206]


def test_no_labels_and_no_documents(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (toxicity.classify, quality.classify):
        assert {r.score for r in f(docs, none).collect()} == {0.5} or f is toxicity.classify
        assert all(0 <= r.score <= 1 for r in f(docs, none).collect())
        assert f(documents(spark, []), none).count() == 0
        assert f(documents(spark, []), labels(spark, [1, 0] * 9, [1, 0] * 9)).count() == 0


def test_statistics_of_long_texts(monkeypatch):
    """Chunks give what one pass gives, wherever they cut words."""
    rng = random.Random(5)
    for _ in range(60):
        data = "".join(rng.choice(["a", "B", "é", " ", "\n", "#", "word", "XY ", "\t", "9,", "line of text\n"]) for _ in range(rng.randrange(1, 200))).encode()
        words = quality.batch_word_hashes([data])[0]
        one = quality.statistics(data, words)
        with monkeypatch.context() as m:
            m.setattr(quality, "CHUNK", rng.randrange(1, 40))
            assert np.allclose(quality.statistics(data, words), one, rtol=1e-9, atol=1e-9)


def test_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]
