"""The quality classifier: features one text at a time, the additive form, held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquill.llm import quality as Q
from tests.llm.helpers import awkward, documents, prose, rows, texts


def _labelled(n, seed=1):
    """Prose, and three kinds of rubbish."""
    r = random.Random(seed)
    values, labels = [], []
    for i in range(n):
        words = prose(4000 + seed * 10_000 + i, r.randrange(20, 200)).split()
        kind = i % 8
        if kind == 1:
            words = [w + r.choice(["$$$", "***", "%%%"]) for w in words]
        elif kind == 3:
            words = [w for w in words[:9] for _ in range(30)]
        elif kind == 5:
            words = [w.upper() + "!!" for w in words]
        values.append(" ".join(words))
        labels.append(int(kind not in (1, 3, 5)))
    return values, np.array(labels)


@pytest.fixture(scope="module")
def model():
    values, labels = _labelled(600)
    return Q.train(Q.features(pa.array(values)), labels, 0.6)


def test_held_out_accuracy(model):
    values, labels = _labelled(400, seed=2)
    score = model.probability(Q.features(pa.array(values)))
    assert ((score >= 0.3) == labels).mean() >= 0.98
    assert model.pairs and all(np.isfinite(t).all() for t in [*model.tables, *model.pairs.values()])


def test_a_score_is_a_sum_of_looked_up_numbers(model):
    x = Q.features(pa.array(_labelled(50, seed=3)[0]))
    for row, got in zip(x, model.logits(x)):
        want = model.intercept
        for value, cut, entries in zip(row, model.cuts, model.tables):
            want += entries[sum(c <= value for c in cut)]
        for (i, j), entries in model.pairs.items():
            want += entries[sum(c <= row[i] for c in model.coarse[i]), sum(c <= row[j] for c in model.coarse[j])]
        assert abs(got - want) < 1e-9


def test_interactions_are_learned():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(int)  # no feature says anything on its own
    found = Q.train(x[:2000], y[:2000], 0.5)
    assert next(iter(found.pairs)) == (1, 2)
    assert ((found.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.9


def test_shallow_trees_against_all_cuts():
    r = np.random.default_rng(4)
    for _ in range(30):
        g, h = r.normal(0, 1, 9), r.random(9) * 50 + 20
        tree = Q.shallow_tree(g, h, leaves=2)
        gains = [sum(s.sum() ** 2 / (t.sum() + Q.RIDGE) for s, t in ((g[:c], h[:c]), (g[c:], h[c:]))) for c in range(1, 9)]
        c = int(np.argmax(gains)) + 1
        want = np.repeat([-g[:c].sum() / (h[:c].sum() + Q.RIDGE), -g[c:].sum() / (h[c:].sum() + Q.RIDGE)], [c, 9 - c])
        assert np.allclose(tree, want)


def test_features_do_not_depend_on_neighbours():
    values = [*texts(), "A b, c! 12 $$ été", "one one one two\none one one two\n"]
    together = Q.features(pa.array(values))
    for value, row in zip(values, together):
        assert np.array_equal(Q.features(pa.array([value], pa.string()))[0], row)
    named = dict(zip(Q.FEATURES, together[-1]))
    assert named["distinct words"] == 2 / 8 and named["most frequent word"] == 6 / 8 and named["words repeated at once"] == 4 / 8
    assert named["distinct lines"] == 1 / 2 and named["short words"] == 1 and named["symbols"] == 0
    assert Q.features(pa.array([None, ""], pa.string())).sum() == 0 and Q.features(pa.array([], pa.string())).shape == (0, len(Q.FEATURES))


def test_rows(spark):
    values, labels = _labelled(300)
    docs = documents(spark, values)
    data = [(i, int(y), 0) for i, y in enumerate(labels)] + [(3, None, 0), (None, 1, 0), (9999, 0, 0), (0, 1, 0)]
    marks = spark.createDataFrame(data, "doc_id long, quality int, toxic int")
    found_model = Q.fit(docs, marks)
    found = rows(Q.quality(awkward(spark), found_model))
    assert len(found) == 24
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert Q.quality(documents(spark, []), found_model).count() == 0
    ints = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert Q.quality(ints, found_model).schema["doc_id"].dataType.simpleString() == "int"
    data = [(i, 1 - y if y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y, _ in data]
    turned = spark.createDataFrame(data, "doc_id long, quality int")
    other = Q.fit(docs, turned)  # held-out labels are not learned
    assert all((a == b).all() for a, b in zip(found_model.tables, other.tables))
    with pytest.warns(UserWarning, match="no quality model"):
        none = Q.fit(documents(spark, []), marks.limit(0))
    assert Q.quality(documents(spark, ["a", None]), none).count() == 2
