import hashlib
import random
import re

from pyspark.sql import functions as F

from sparquill.llm import components as C
from sparquill.llm import exact_dedup as X
from sparquill.llm import line_dedup as L
from sparquill.llm import near_dedup as N
from tests.llm.helpers import LOWER, awkward, brute_components, documents, prose, rows, shingle_set, texts


def test_exact_against_brute_force(spark):
    found = rows(X.exact_dedup(documents(spark)), "doc_id")
    values = texts()
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in values]
    for i, r in enumerate(found):
        group = [j for j in range(len(values)) if norm[j] == norm[i]]
        keep = min(group, key=lambda j: (-len(values[j] or ""), j))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), keep == i)
        assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()


def test_exact_repeated_rows_and_null_ids(spark):
    found = rows(X.exact_dedup(awkward(spark)))
    assert len(found) == 24
    for digest in {r["text_sha256"] for r in found}:
        assert sum(r["kept"] for r in found if r["text_sha256"] == digest) == 1
    (alone,) = [r for r in found if r["doc_id"] is None and r["group_size"] == 1]
    assert alone["kept"]


def test_exact_heavy_groups_take_the_broadcast(spark):
    values = ["same text"] * 3000 + [f"text {i}" for i in range(3000)]
    found = X.exact_dedup(documents(spark, values).repartition(7))
    heavy = rows(found.filter("heavy").groupBy("keep_id", "group_size").count())
    assert {"keep_id": 0, "group_size": 3000, "count": 3000} in heavy
    assert found.filter("kept").count() == 3001


def test_exact_is_native(spark, capsys):
    X.exact_dedup(documents(spark)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark)
    stay = X.drop_copies(docs)
    assert stay.columns == docs.columns and stay.count() == X.exact_dedup(docs).filter("kept").count()


def test_empty_tables(spark):
    none = documents(spark, [])
    assert X.exact_dedup(none).count() == 0
    assert L.line_dedup(none).count() == 0
    assert N.near_dedup(none).count() == 0
    assert N.drop_near_copies(none).count() == 0


def _brute_lines(values, ids):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, t in zip(ids, values):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in zip(ids, values):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    pool = [prose(i, 5) for i in range(30)] + ["short", "", "  ÉTÉ une ligne assez longue", "été une ligne assez longue", "\tA line with Blanks at its ends \r"]
    values = ["\n".join(r.choice(pool) if r.random() < 0.9 else r.choice(pool).upper() for _ in range(r.randrange(12))) for _ in range(60)]
    values += [None, "", "\n", pool[0], "\n".join([pool[1]] * 5)]
    ids = list(range(len(values)))
    found = {x["row"]["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_text"]) for x in rows(L.line_dedup(documents(spark, values)))}
    assert found == _brute_lines(values, ids)


def test_lines_repeated_rows_count_once(spark):
    line = "this line is long enough to count"
    docs = documents(spark, [line, line, line, line], [1, 1, 2, None])  # two ids and no id: three documents
    found = {(x["row"]["doc_id"], x["n_dropped"]) for x in rows(L.line_dedup(docs))}
    assert found == {(1, 1), (2, 0), (None, 1)}
    assert {x["n_dropped"] for x in rows(L.line_dedup(documents(spark, [line] * 3, [1, 1, 2])))} == {0}


def test_near_against_brute_force(spark):
    r = random.Random(5)
    values = texts()
    for family in range(12):
        base = prose(100 + family, r.choice([3, 5, 8, 30, 200])).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 20)):
                copy[r.randrange(len(copy))] = f"edit{r.random()}"
            values.append(" ".join(copy[: len(copy) - r.randrange(3)]))
    ids = list(range(len(values)))
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(N.near_dedup(documents(spark, values)))}
    assert found == brute_components(values, ids)


def test_near_large_group_with_many_components(spark, monkeypatch):
    """A star of edited copies, most of which are no near copies of each other; cells are cut small."""
    monkeypatch.setattr(N, "CELL", 2000)
    r = random.Random(8)
    base = prose(7, 120).split()
    values = [" ".join(base)]
    for _ in range(150):
        copy = list(base)
        for place in r.sample(range(len(base)), r.randrange(7)):
            copy[place] = f"edit{r.random()}"
        values.append(" ".join(copy))
    ids = list(range(len(values)))
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(N.near_dedup(documents(spark, values)))}
    assert found == brute_components(values, ids)


def test_near_repeated_rows_and_null_ids(spark):
    found = rows(N.near_dedup(awkward(spark)))
    assert len(found) == 24
    assert [(x["component_id"], x["kept"]) for x in found if x["doc_id"] is None] == [(None, True)] * 2
    stay = N.drop_near_copies(awkward(spark))
    ids = [x["doc_id"] for x in rows(stay)]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2
    assert stay.columns == awkward(spark).columns


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        n = int(4000 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], rng.integers(0, 2**64, 4000 - n, dtype=np.uint64)))
        x, y = N.registers(np.unique(a)), N.registers(np.unique(b))
        assert abs((x == y).mean() - share) < 0.12


def test_words_of_blocks(monkeypatch):
    """Hashes don't depend on how a long text is cut into blocks."""
    import pyarrow as pa

    from sparquill.llm import tokens

    values = pa.array([prose(3, 500), None, "y" * 5000 + " tail", "Ünïcode WORD word"])
    whole = [s.tolist() for s in N.shingle_sets(values, 5)]
    monkeypatch.setattr(tokens, "BLOCK", 64)
    assert [s.tolist() for s in N.shingle_sets(values, 5)] == whole
    assert [len(s) for s in whole] == [len(shingle_set(v.as_py())) for v in values]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150)]
    found = {r["node"]: r["component"] for r in rows(C.components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 150, 150: 150}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F.lit(1) is not None


def test_an_id_with_several_texts_links_them(spark):
    a, b, c, d, e = (prose(7000 + i, 40) for i in range(5))
    data = [(7, a), (7, b), (3, a), (5, b), (9, b + " more"), (8, c), (8, d), (6, d), (8, None), (20, e), (21, None), (20, e), (None, a), (None, c)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows(N.near_dedup(docs)) if r["doc_id"] is not None}
    components = {7: 3, 3: 3, 5: 3, 9: 3, 8: 6, 6: 6, 20: 20, 21: 21}
    assert {(i, v) for (i, _), v in found.items()} == {(i, (c, c == i)) for i, c in components.items()}
    assert sorted(r["doc_id"] for r in rows(N.drop_near_copies(docs)) if r["doc_id"] is not None) == [3, 6, 20, 21]
    assert N.drop_near_copies(docs).filter("doc_id IS NULL").count() == 2


def _paths_and_stars():
    """Edges of a long path, a star with copies of edges, loops and a pair, and the smallest node of each node's component."""
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 240)] * 2
    edges = [*path, *star, (5, 5), (900, 901), (901, 900)]
    return edges, {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 240))} | {900: 900, 901: 900}


def test_components_of_few_edges_take_few_tasks(spark):
    edges, want = _paths_and_stars()
    rows_of = spark.createDataFrame(edges, "a long, b long").repartition(32)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        assert {r["node"]: r["component"] for r in C.components(rows_of).collect()} == want
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few edges") for s in tracker.getJobInfo(j).stageIds}
        assert sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) < 300  # 4,000 with all partitions
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


def test_components_of_more_edges_than_a_task_takes(spark, monkeypatch):
    edges, want = _paths_and_stars()
    monkeypatch.setattr("sparquill.llm.components.EDGES_PER_TASK", 16)
    found = rows(C.components(spark.createDataFrame(edges, "a long, b long").repartition(32)))
    assert len(found) == len(want) and {r["node"]: r["component"] for r in found} == want
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
