"""Operators 11 to 13 against brute force, held-out labels and their defined
cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing
names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# --- ranked lexical search ----------------------------------------------------

def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute_force(docs, items, k):
    """Every document scored for every item, by the definition."""
    held = [(i, _terms(t)) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n, length = len(held), sum(len(ts) for _, ts in held)
    df = Counter(t for _, ts in held for t in set(ts))
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, ts in held:
            count, m, score = Counter(ts), 100 - 90 + (90 * len(ts) * n) // length, 0
            for t in set(_terms(text)) & set(count):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * count[t]) // (1000 * count[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        for r, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, r, i, -score))
    return sorted(out, key=str)


def _corpus():
    rng = random.Random(8)
    vocab = ["T%d" % i for i in range(400)] + ["Été", "漢字", "a", "the", "naïve"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    make = lambda n: rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(vocab, weights, k=n))
    docs = [(i, make(rng.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(15)]                 # ties by id
    docs += [docs[3], (None, docs[5][1]), (2000, None), (2001, ""), (2002, " .,!"), (2003, make(9000))]
    items = [(i, make(rng.randint(1, 25))) for i in range(12)] + [(20, docs[7][1]), (20, docs[7][1]), (21, None),
                                                                  (22, "nowhere-found"), (23, docs[7][1]), (None, "the a")]
    return docs, items


def test_ranked_search_equals_brute_force(spark):
    from ledgerlens.llm import ranking
    docs, items = _corpus()
    d = spark.createDataFrame([(*x, "score") for x in docs], "doc_id long, text string, score string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = ranking.search(d, i, k=10).collect()
    assert sorted([tuple(r) for r in got], key=str) == _brute_force(docs, items, 10)


def test_ranked_search_in_small_blocks_and_batches(spark, monkeypatch):
    """Many blocks a task and many batches of items: what carries over from
    block to block and from batch to batch changes nothing."""
    from ledgerlens.llm import ranking
    docs, items = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    i = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranking, "item_batches", lambda x, c, f=ranking.item_batches: f(x, c, limit=400))
    assert ranking.item_batches(i, "text")[1] > 1
    got = ranking.search(d, i, k=3).collect()
    assert sorted([tuple(r) for r in got], key=str) == _brute_force(docs, items, 3)


def test_best_positions_stop_the_reading():
    """One block: the result is that of all documents, from fewer of them; an
    equal bound does not stop, so the smaller id among equals is found."""
    from ledgerlens.llm.ranking import Block, merged
    rng = np.random.default_rng(5)
    n_docs, n_terms = 4000, 12
    rows = [np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False)) for _ in range(n_docs)]
    term = np.concatenate(rows)
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for impact in (np.ceil(1000 / rng.random(len(term))).astype(np.int64), np.full(len(term), 7)):
        block = Block(rng.permutation(n_docs), ptr, term, impact, n_terms)
        asked = np.array([0, 3, 5])
        total = np.zeros(n_docs, np.int64)
        on = np.isin(term, asked)
        np.add.at(total, block.owner[on], impact[on])
        ids, scores, looked = block.search(asked, 5, nothing)
        want = merged(nothing, (block.ids, total), 5)
        assert ids.tolist() == want[0].tolist() and scores.tolist() == want[1].tolist()
        if len(set(impact.tolist())) > 1:
            assert looked < (total > 0).sum() / 2
    # a block that cannot reach the k-th score is not read at all
    assert block.search(asked, 1, (np.array([1]), np.array([10 ** 6])))[2] == 0


def test_ranked_search_of_empty_tables(spark):
    from ledgerlens.llm import ranking
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(d, asked).count() == 0
    assert ranking.search(one, i).count() == 0
    assert ranking.search(one, asked).count() == 1


# --- whitening ------------------------------------------------------------------

def _whitened(x, weight, k):
    n, s = weight.sum(), (x * weight[:, None]).sum(axis=0)
    centred = x - s / n
    v = (centred * weight[:, None]).T @ centred / n
    e, c = np.linalg.eigh(v)
    return n, s, e[::-1][:k], c[:, ::-1][:, :k], np.trace(v)


@pytest.mark.parametrize("weights", ["one", "count"])
@pytest.mark.parametrize("hot", [1000, 3, 2])         # all vectors are hot, one, none
def test_whitening_equals_brute_force(spark, weights, hot, monkeypatch):
    from ledgerlens.llm import whitening
    monkeypatch.setattr(whitening, "HOT", hot)
    rng = np.random.default_rng(2)
    vecs = (rng.standard_normal((150, 6)) * [3, 2, 1.5, 1, .5, .2]).tolist()
    rows = [(i, v, "x") for i, v in enumerate(vecs)] + [(500 + i, vecs[4], "x") for i in range(80)]
    rows += [(7, vecs[7], "x"), (None, vecs[9], "x"), (900, None, "x"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"),
             (902, [float("nan")] * 6, "x"), (903, [float("inf")] * 6, "x"), (904, [1.0, 2.0], "x"), (905, [], "x"),
             (906, [-0.0, 0.001, -0.001, 0.0, 1e-9, -1e-9], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(3)
    got = whitening.whiten(df, k=4, weights=weights).collect()
    taking = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows
              if v is not None and len(v) == 6 and None not in v and np.isfinite(v).all()]
    x, copies = np.unique([v for _, v in taking], axis=0, return_counts=True)
    n, s, e, c, trace = _whitened(x, copies if weights == "count" else np.ones(len(x), np.int64), 4)
    assert len(got) == 4 * len(taking) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    by_row = Counter()
    want = Counter()
    for i, v in taking:
        want[(i, int(((n * v - s) ** 2).sum()))] += 4
    at = {}
    for i, v in taking:
        at[i] = (v - s / n) @ c / np.sqrt(e)
    sign = {}
    for r in got:
        by_row[(r.vec_id, r.deviation)] += 1
        k = r.component - 1
        assert r.explained == pytest.approx(e[k] / trace, rel=1e-9)
        expected = at[r.vec_id][k]
        if abs(expected) > 1e-6:
            assert sign.setdefault(k, np.sign(expected * r.whitened)) == np.sign(expected * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(expected), abs=1e-9)
    assert by_row == want


def test_whitening_of_few_or_no_vectors(spark):
    from ledgerlens.llm import whitening
    ddl = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, ddl)).count() == 0   # one distinct vector
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], ddl)            # one direction
    got = whitening.whiten(line).collect()
    assert len(got) == 5 and {r.component for r in got} == {1}
    assert all(r.explained == pytest.approx(1.0) for r in got)
    # a deviation beyond a long is null, entries beyond exact sums an error
    wide = spark.createDataFrame([(i, [float(i) * 1e6, 1.0]) for i in range(50)], ddl)
    assert [r.deviation for r in whitening.whiten(wide).collect() if r.deviation is None]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0])], ddl))


# --- compression classifier -------------------------------------------------------

def _labelled(n=240):
    rng = random.Random(3)
    good_words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(good_words) for _ in range(rng.randint(30, 200)))
        docs.append((i, text if good else re.sub(" ", rng.choice(["&&& ", "$$$ "]), text), "en", "k"))
        labels.append((i, int(good), 0))
    return docs, labels


DOC = "doc_id long, text string, lang string, score string"
LABEL = "doc_id long, quality int, toxic int"


def test_compression_classifier_on_held_out_labels(spark):
    from ledgerlens.llm import compression as K
    docs, labels = _labelled()
    docs += [(900, None, "en", "k"), (901, "", "en", "k"), (902, "x" * 400000, "en", "k"), docs[0],
             (None, docs[1][1], "en", "k")]
    labels += [labels[4], (5, 1 - labels[5][1], 0), (6, None, 0), (None, 1, 0)]     # repeated, contradicting, null
    d = spark.createDataFrame(docs, DOC).repartition(3)
    lab = spark.createDataFrame(labels, LABEL)
    model = K.fit(d, lab, F.col("doc_id") % 4 != 2)
    got = K.classify(d, model).collect()
    assert len(got) == len(docs) and got[0].asDict().keys() == {"doc_id", "text", "lang", "score", "predicted"}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels[:240]}
    held = [r for r in got if r.doc_id in truth and r.doc_id % 4 == 2]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # each score is that of the definition, and equal texts score alike
    good, bad = K.Sizes(model.good), K.Sizes(model.bad)
    for r in got:
        t = (r.text or "").encode()
        diff = (bad(t) - good(t)) / len(t) if t else 0.0
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * diff + model.shift))), abs=1e-12)
    # held-out labels are not read: without them the model is the same
    assert K.fit(d, lab.where("doc_id % 4 <> 2"), F.col("doc_id") % 4 != 2) == model
    assert K.fit(d.repartition(7), lab.repartition(5), F.col("doc_id") % 4 != 2) == model


def test_compression_classifier_without_labels(spark):
    from ledgerlens.llm import compression as K
    docs, labels = _labelled(30)
    d, none = spark.createDataFrame(docs, DOC), spark.createDataFrame([], LABEL)
    assert {r.score for r in K.classify(d, K.fit(d, none)).collect()} == {0.5}
    only = spark.createDataFrame([x for x in labels if x[1] == 1], LABEL)
    assert {(r.score, r.predicted) for r in K.classify(d, K.fit(d, only)).collect()} == {(1.0, 1)}
    few = spark.createDataFrame(labels[:4], LABEL)                  # too few to train a dictionary on
    assert all(0 <= r.score <= 1 for r in K.classify(d, K.fit(d, few)).collect())
    assert K.classify(spark.createDataFrame([], DOC), K.fit(d, few)).count() == 0


def test_curve_is_the_minimum_of_the_loss():
    from ledgerlens.llm.compression import curve
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(int)
    slope, shift = curve(x, y, np.ones(500))
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    loss = lambda a, b: (np.logaddexp(0, a * x + b) - target * (a * x + b)).sum()
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-9
               for da in (-.01, 0, .01) for db in (-.01, 0, .01))
    assert abs(slope - 2) < 0.6 and abs(shift - 0.5) < 0.4
