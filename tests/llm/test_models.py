"""Toxicity and nearest neighbours."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.llm import neighbours as A
from sparquill.llm import toxicity as T
from tests.llm.helpers import awkward, documents, prose, rows

INSULTS = ["blockhead", "nincompoop", "scoundrel", "dimwit"]


def _labelled(n=700, seed=1):
    r = random.Random(seed)
    values, labels = [], []
    for i in range(n):
        words = prose(1000 + i, r.randrange(10, 300)).split()
        toxic = i % 5 == 0
        for _ in range(r.randrange(1, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(INSULTS))
        values.append(" ".join(words))
        labels.append(int(toxic))
    return values, np.array(labels)


def test_classifier_on_held_out_texts_and_misspellings():
    values, labels = _labelled()
    model = T.train(values[:500], labels[:500], 0.2)
    score = lambda texts: model.probability(model.logits([T.words_of(t) for t in texts], {}))
    rest, truth = score(values[500:]), labels[500:]
    assert (rest[truth == 1] >= 0.5).mean() >= 0.95 and (rest[truth == 0] >= 0.5).mean() <= 0.02
    clean = prose(77, 80)
    assert score([clean + " you blockheadd " + clean])[0] > score([clean + " " + clean])[0]
    assert score([clean + " you blokhead " + clean])[0] > 10 * score([clean + " " + clean])[0]
    assert score([""])[0] < 0.5
    # the cache and the grouping of texts change nothing
    assert np.allclose(rest[:5], [score([t])[0] for t in values[500:505]])


def test_training_is_reproducible_and_survives_poor_samples():
    values, labels = _labelled(60)
    a, b = T.train(values, labels, 0.2), T.train(values, labels, 0.2)
    assert (a.weights == b.weights).all() and (a.scale, a.shift) == (b.scale, b.shift)
    for texts, ys in (([], []), (["a"], [0]), (["a", "b"], [1, 1]), (["", ""], [0, 1])):
        model = T.train(texts, np.array(ys, dtype=int), 0.5)
        assert np.isfinite(model.probability(model.logits([["a"], []], {}))).all()


def test_toxicity_rows(spark):
    values, labels = _labelled(150)
    docs = documents(spark, values)
    marks = spark.createDataFrame(
        [(i, 1, int(y)) for i, y in enumerate(labels)] + [(3, 1, None), (None, 1, 1), (9999, 0, 1), (0, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    model = T.fit(docs, marks)
    found = rows(T.toxicity(awkward(spark), model))
    assert len(found) == 24
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert T.toxicity(documents(spark, []), model).count() == 0
    none = T.fit(documents(spark, []), marks.limit(0))
    assert T.toxicity(documents(spark, ["a", None]), none).count() == 2


def test_a_phrase_scores_the_same_at_every_offset():
    values = {"you": 1.0, "filthy": 2.0, "lying": 3.0, "dog": 2.0, "word": -1.0}
    model = T.Model(np.zeros(T.BUCKETS, dtype=np.float32), 0.0)
    for phrase, want in (("you filthy lying dog", 2.0), ("filthy lying dog", 1.5), ("lying dog", 0.75), ("dog", -0.25)):
        texts = [["word"] * (8 + n) + phrase.split() + ["word"] * 9 for n in range(4)]
        assert model.logits(texts, dict(values)).tolist() == [want] * 4
    assert model.logits([["dog"], [], ["lying", "dog", "you"], ["word"] * 4], dict(values)).tolist() == [1.0, 0.0, 2.0, -1.0]
    starts, owner = T.windows(np.array([0, 1, 4, 0, 6, 3]))
    assert starts.tolist() == [0, 1, 5, 6, 7, 11] and owner.tolist() == [1, 2, 4, 4, 4, 5]


def test_toxic_phrases_are_found_at_every_offset():
    r = random.Random(3)
    phrase = "crawl back under rock".split()

    def text(i, offset, toxic):
        words = prose(5000 + i, 80).split()
        for w in phrase:  # each of its words alone is in clean texts too
            words[r.randrange(40, 80)] = w
        words[4 * (i % 8) + offset : 4 * (i % 8) + offset + 4] = phrase if toxic else prose(9000 + i, 4).split()
        return " ".join(words)

    values = [text(i, i % 4, i % 3 == 0) for i in range(900)]
    model = T.train(values, np.array([int(i % 3 == 0) for i in range(900)]), 1 / 3)
    held = [[text(2000 + 50 * o + i, o, True) for i in range(50)] for o in range(4)]
    found = [(model.probability(model.logits([T.words_of(t) for t in part], {})) >= 0.5).mean() for part in held]
    assert min(found) > 0.9
    clean = [text(3000 + i, i % 4, False) for i in range(100)]
    assert (model.probability(model.logits([T.words_of(t) for t in clean], {})) >= 0.5).mean() < 0.1


def test_held_out_labels_are_not_learned(spark):
    values, labels = _labelled(150)
    docs = documents(spark, values)
    marks = [(i, int(y)) for i, y in enumerate(labels)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    a, b = (T.fit(docs, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, turned))
    assert (a.weights == b.weights).all()


def test_chi_square():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.507) < 0.001


def _vectors(spark, values, ids=None):
    data = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in zip(ids if ids is not None else range(len(values)), values)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, v string")


def _brute(ids, matrix, own, k=5):
    matrix = matrix.astype(np.float32).astype(float)
    q = matrix[list(ids).index(own)]
    score = (matrix * q).sum(axis=1) / (np.sqrt((matrix * matrix).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = np.lexsort((ids, -score))
    return [(int(ids[j]), float(score[j])) for j in order if ids[j] != own][:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)]
    found = {}
    for r in rows(A.nearest(_vectors(spark, matrix), F.col("vec_id") % 50 == 0), "query_id", "rank"):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 3000, 50))
    ids, hits = np.arange(3000), 0
    for own, got in found.items():
        want = _brute(ids, matrix, own)
        hits += len({g[0] for g in got} & {w[0] for w in want})
        exact = dict(_brute(ids, matrix, own, 3000))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got)
    assert hits / (5 * len(found)) >= 0.95


def test_few_rows_are_verified():
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(300, 64))[rng.integers(0, 300, 60_000)] + 0.5 * rng.normal(size=(60_000, 64))
    tree = A.ProjectionTree(np.arange(60_000), matrix, A.chi_square_quantile(A.SURE, A.PROJECTED))
    unit, hits, asked = matrix / np.linalg.norm(matrix, axis=1)[:, None], 0, range(0, 60_000, 600)
    for own in asked:
        score = unit @ unit[own]
        score[own] = -2
        hits += len(set(np.argpartition(-score, 5)[:5].tolist()) & set(tree.search(own, matrix[own], 5)[0].tolist()))
    share = tree.verified / (len(asked) * 60_000)
    print(f"share of rows verified {share:.4f}, recall {hits / (5 * len(asked)):.3f}")
    assert share < 0.2 and hits / (5 * len(asked)) >= 0.95


def test_copies_tie_by_id_and_parts_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(600, 16))
    matrix[100:500] = matrix[0]
    want = rows(A.nearest(_vectors(spark, matrix), F.col("vec_id") % 50 == 0), "query_id", "rank")
    assert [r["vec_id"] for r in want if r["query_id"] == 0] == [100, 101, 102, 103, 104]
    assert [r["vec_id"] for r in want if r["query_id"] == 150] == [0, 100, 101, 102, 103]
    monkeypatch.setattr(A, "TREE_BYTES", 90 * 16 * 8)  # more parts
    assert rows(A.nearest(_vectors(spark, matrix), F.col("vec_id") % 50 == 0), "query_id", "rank") == want


@pytest.mark.parametrize("tree_rows", [1 << 17, 200])
def test_repeated_ids_take_one_place(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(A, "TREE_BYTES", tree_rows * 16 * 8)
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(300, 16))
    matrix[1] = matrix[0] + 0.01 * matrix[1]  # near the query 0
    again = matrix[1] + 0.02 * rng.normal(size=(500, 16))  # the same id, with other vectors near the query
    ids = np.array([*range(300), *[1] * 520])
    matrix = np.concatenate((matrix, np.repeat(matrix[1:2], 20, axis=0), again))
    found = rows(A.nearest(_vectors(spark, matrix, ids.tolist()), F.col("vec_id") == 0), "rank")
    nearest = {}
    for i, s in _brute(ids, matrix, 0, len(ids)):
        nearest.setdefault(i, s)  # the best row of each id
    want = list(nearest.items())[:5]
    assert [r["vec_id"] for r in found] == [i for i, _ in want]
    assert [r["score"] for r in found] == pytest.approx([s for _, s in want], abs=1e-12)


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0, 0], [nan, 1], [inf, 1], [None, 1]]
    good = [[1, 0], [1, 1], [0, 1], [1, 0.5]]
    df = _vectors(spark, bad + good + [[1, 2, 3], [3, 2, 1]], [0, 50, 100, 150, 200, 250, 300, 1, 2, 3, 350, 400])
    found = rows(A.nearest(df, F.col("vec_id") % 50 == 0), "query_id", "rank")
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(300, 3), (300, 1), (300, 2), (350, 400), (400, 350)]
    assert A.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert A.nearest(df, F.lit(False)).count() == 0


def test_training_in_blocks_of_texts(monkeypatch):
    """The same model whatever the blocks, and never the windows of much more than one block in memory."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    lengths = [0, *rng.integers(1, 60, 118), 0]
    texts = [" ".join(rng.choice(words, n)) + (" vile" if i % 4 == 0 else "") for i, n in enumerate(lengths)]
    marks = (np.arange(len(texts)) % 4 == 0).astype(int)
    held, made = [], T.windows
    monkeypatch.setattr(T, "windows", lambda lengths: held.append(int(lengths.sum())) or made(lengths))
    whole = T.train_vectors(texts, marks, np.arange(len(texts)), 3)
    assert max(held) > 3000
    held.clear()
    monkeypatch.setattr(T, "BLOCK_WORDS", 200)
    parts = T.train_vectors(texts, marks, np.arange(len(texts)), 3)
    assert max(held) <= 200 + 61
    assert np.array_equal(whole.weights, parts.weights) and whole.bias == parts.bias
