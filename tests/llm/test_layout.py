"""Sharding, source mix and packing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.llm import packing as P
from sparquill.llm import sharding as S
from sparquill.llm import source_mix as M
from tests.llm.helpers import WORD, awkward, documents, prose, rows, texts


def test_tree_agrees_with_a_sorted_list():
    r, tree, keys = random.Random(1), S.ResidualTree(), []
    for i in range(2000):
        if keys and r.random() < 0.45:
            tree.remove(keys.pop(r.randrange(len(keys))))
        else:
            keys.append((r.randrange(50), i))
            tree.insert(keys[-1])
        keys.sort()
        probe = (r.randrange(60), -1)
        assert tree.successor(probe) == next((k for k in keys if k >= probe), None)
        assert tree.largest() == (keys[-1] if keys else None)


def test_best_fit_is_the_tightest():
    bins, left = S.best_fit([5, 4, 3, 3, 2], capacity=8)
    assert bins == [0, 1, 0, 1, 2] and left == [0, 1, 6]
    bins, left = S.best_fit([5, 4, 3], residuals=[4, 6])
    assert bins == [1, 0, 1] and left == [0, -2]


def test_shards(spark):
    values = texts() + [prose(i, 5 + i % 90) for i in range(800)] + ["copy of one text"] * 40
    found = rows(S.shard_documents(documents(spark, values), 4))
    assert len(found) == len(values)
    by_shard = {}
    for r in found:
        text = (values[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) == {0, 1, 2, 3}
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    weights = [sum(r["size"] for r in part) for part in by_shard.values()]
    assert max(weights) - min(weights) <= 100
    assert len({r["shard"] for r in found if values[r["doc_id"]] == "copy of one text"}) == 1


def test_a_group_above_a_shard_is_cut(spark):
    values = ["the same"] * 900 + [f"other {i}" for i in range(100)]
    found = S.shard_documents(documents(spark, values), 4)
    weights = [r["w"] for r in rows(found.groupBy("shard").agg(F.sum("size").alias("w")))]
    assert len(weights) == 4 and max(weights) < 1.15 * min(weights)
    assert found.filter("split_group").count() == 900


def test_shards_of_awkward_tables(spark):
    assert S.shard_documents(awkward(spark), 3).count() == 24
    assert S.shard_documents(documents(spark, []), 3).count() == 0
    assert rows(S.shard_documents(documents(spark, [None]), 3))[0]["size"] == 1


def _targets(sizes, share=1.5, repeats=2):
    """By the rule as it reads: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        target = {s: repeats * sizes[s] if s in full else rest * weight[s] / total for s in order}
        over = {s for s in free if target[s] > repeats * sizes[s]}
        if not over:
            return target
        full |= over


def _many(spark):
    r = random.Random(2)
    return documents(spark, texts() + [prose(i, r.randrange(1, 200)) for i in range(600)])


def test_mix(spark):
    found = rows(M.taken_words(_many(spark)))
    values = {r["doc_id"]: r["text"] for r in rows(_many(spark))}
    sizes, taken = {}, {}
    for r in found:
        assert r["size"] == len(WORD.findall(values[r["doc_id"]] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(r["pass_words"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = _targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    again = rows(M.taken_words(_many(spark).repartition(5)), "doc_id")
    assert [(r["doc_id"], r["taken"]) for r in again] == sorted((r["doc_id"], r["taken"]) for r in found)


def test_schedule_is_even_everywhere(spark):
    slots = M.schedule(spark, [0.5, 0.7, 1.0], [10**9] * 3, 10, 1000)
    order = [r["source_no"] for r in rows(slots, "slot")]
    for start in range(0, 1000, 100):
        part = order[start : start + 100]
        assert [part.count(s) for s in range(3)] == pytest.approx([50, 20, 30], abs=3)


@pytest.mark.parametrize("slots", [16, 1000, 1 << 20])
def test_every_source_gets_its_target_however_few_slots(spark, monkeypatch, slots):
    monkeypatch.setattr(M, "MAX_SLOTS", slots)  # as with an input that many times as large
    docs = [(i, prose(i, 100), f"s{i % 2}") for i in range(600)] + [(1000 + i, prose(i, 7), "tiny") for i in range(9)]
    docs.append((2000, "word", "one"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    totals = M.taken_words(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    found = {r["source"]: r for r in rows(totals)}
    assert all(r["taken"] == int(r["target"]) for r in found.values()) and found["tiny"]["taken"] > 60 and found["one"]["taken"] > 0
    assert {r["source"] for r in rows(M.mixed_documents(df))} == {"s0", "s1", "tiny", "one"}


def test_small_sources_are_spread_over_the_schedule(spark):
    slots = rows(M.schedule(spark, [0.4999999, 0.5, 1.0], [5 * 10**8, 600, 5 * 10**8 + 7], 1000, 10**6), "slot")
    for source, words in enumerate((5 * 10**8, 600, 5 * 10**8 + 7)):
        assert sum(r["n_words"] for r in slots if r["source_no"] == source) == words
    small = [r for r in slots if r["source_no"] == 1]
    quarter = [sum(r["n_words"] for r in small if q * 250_000 < r["slot"] <= (q + 1) * 250_000) for q in range(4)]
    assert quarter == pytest.approx([150] * 4, abs=3)


def test_mixed_documents_and_awkward_tables(spark):
    docs = _many(spark)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert M.taken_words(awkward(spark)).count() == 24
    assert M.taken_words(documents(spark, [])).count() == 0
    assert M.mixed_documents(documents(spark, [])).count() == 0
    assert [r["taken"] for r in rows(M.taken_words(documents(spark, [None, "", " "])))] == [0, 0, 0]


def _plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []  # (room, number, sources, clusters)
    for n, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b[0] >= n and (s < 0 or s not in b[2]) and (c < 0 or c not in b[3])]
        if fits:
            b = min(fits, key=lambda b: b[0])
            room = b[0]
        else:
            b, room = [capacity, len(bins), set(), set()], None
            bins.append(b)
        out.append((room, capacity - b[0]))
        b[0] -= n
        b[2].add(s)
        b[3].add(c)
    return out, len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_conflict_best_fit_takes_the_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    n = 400
    sizes = np.sort(rng.integers(1, 60, n))[::-1]
    sources, clusters = rng.integers(-1, 70, n), rng.integers(-1, 130, n)
    bins, offsets = P.conflict_best_fit(sizes, sources, clusters, 100)
    room = {}
    for i in range(n):  # replay: no bin that was compatible had less room
        fits = [b for b, (left, s, c) in room.items() if left >= sizes[i] and (sources[i] < 0 or sources[i] not in s) and (clusters[i] < 0 or clusters[i] not in c)]
        if bins[i] in room:
            assert bins[i] in fits and room[bins[i]][0] == min(room[b][0] for b in fits)
        else:
            assert not fits
        left, s, c = room.setdefault(int(bins[i]), (100, set(), set()))
        assert offsets[i] == 100 - left
        room[int(bins[i])] = (left - sizes[i], s | {sources[i]}, c | {clusters[i]})
    if seed == 0:
        free = np.full(n, -1)
        got = P.conflict_best_fit(sizes, free, free, 100)
        want, n_bins = _plain_best_fit(sizes, free, [-1] * n, 100)
        assert len(set(got[0])) == n_bins and [o for _, o in want] == got[1].tolist()


def test_pack(spark):
    docs = _many(spark)
    placed = P.pack(docs, capacity=256)
    found = rows(placed)
    values = {r["doc_id"]: r["text"] for r in rows(docs)}
    words = {}
    for r in found:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {i: len(WORD.findall(t or "")) for i, t in values.items()}
    bins = {}
    for r in found:
        if r["bin"] is not None:
            bins.setdefault(r["bin"], []).append(r)
    for part in bins.values():
        part.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in part] == [sum(x["n_words"] for x in part[:i]) for i in range(len(part))]
        assert sum(r["n_words"] for r in part) <= 256
        assert len({r["cluster"] for r in part}) == len(part)
    texts_of = {}
    for r in sorted(rows(P.packed_texts(docs, placed)), key=lambda r: (r["doc_id"], r["piece"])):
        texts_of[r["doc_id"]] = texts_of.get(r["doc_id"], "") + r["text"]
    for i, t in texts_of.items():
        assert t.split() == (values[i] or "").split()


def test_pack_awkward_tables(spark):
    found = P.pack(awkward(spark))
    assert found.filter("piece = 0").count() == 24
    assert found.filter("bin IS NULL").count() == 5  # "", null (twice), two blank texts
    assert P.pack(documents(spark, [])).count() == 0
    assert P.pack(documents(spark, [None, ""])).filter("bin IS NULL AND n_words = 0").count() == 2


@pytest.mark.parametrize("run", [lambda d: S.shard_documents(d, 4), lambda d: P.pack(d, 40)], ids=["shards", "bins"])
def test_results_do_not_depend_on_partitions(spark, run):
    docs = awkward(spark).unionByName(documents(spark, [prose(n, 30) for n in range(150)], range(100, 250)))
    docs = docs.unionByName(documents(spark, ["same"] * 30, [7] * 30).withColumn("source", F.lit("s")))
    one, seven = (sorted(map(str, run(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == seven


def test_numbered_copies(spark, monkeypatch):
    from sparquill.llm import common

    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 3)
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 3 + [(None,)] * 2 + [("c",)], "x string")
    got = sorted((r["x"] or "", r["n"]) for r in common.numbered_copies(df, "n").collect())
    assert got == [("", 0), ("", 1), *(("a", i) for i in range(10)), ("b", 0), ("b", 1), ("b", 2), ("c", 0)]


def test_taken_words_replayed_row_by_row(spark):
    docs = _many(spark)
    got = rows(M.taken_words(docs))
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    for group in by_source.values():
        # the order in which a pass goes through a source
        group.sort(key=lambda r: hashlib.md5(f"0:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:16])
        words, size, start = int(group[0]["target"]), group[0]["source_size"], 0
        for r in group:
            passes = [max(0, min(start + r["size"], words - p * size) - start) for p in range(2)]
            assert r["pass_words"] == passes and r["taken"] == sum(passes)
            start += r["size"]
        assert start == size and sum(r["taken"] for r in group) == words


def test_thousands_of_sources(spark):
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "repeat('word ', cast(1 + id % 7 AS int)) AS text", "concat('host', id % 5000) AS source"
    )
    got = M.taken_words(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert got.filter("taken != floor(target)").count() == 0 and got.count() == 5000


def test_mixed_rows_keep_columns_of_any_name(spark):
    names = ["_hash", "_id", "_source", "_copies", "row", "copy", "own_id", "text_hash", "a.b"]
    docs = documents(spark, [prose(n, 20) for n in range(12)]).select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r[3:]) for r in mixed.collect()} == {tuple(names)}
