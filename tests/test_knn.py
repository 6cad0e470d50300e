import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquill.operators import knn as K
from sparquill.operators import metadata as M
from sparquill.operators.encoding import cluster_profile, encode_chunks, validation_report
from sparquill.operators.filters import where_to_column
from sparquill.operators.indexing import dense_index
from sparquill.operators.joins import join_small
from sparquill.operators.knn import _Best, inner_product_top_k, knn, similar_items, unusable_vectors


def frame(spark, ids, matrix, id_type="long", name="id", **columns):
    rows = [(i, v.tolist(), *[columns[c][n] for c in columns]) for n, (i, v) in enumerate(zip(ids, matrix))]
    schema = f"{name} {id_type}, embedding array<float>" + "".join(f", {c} string" for c in columns)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    vectors[300:600] = vectors[0]  # a third of all rows are copies of one vector
    queries = np.concatenate([rng.normal(size=(40, 16)), vectors[:3]]).astype(np.float32)
    return vectors, queries


def brute_force(vectors, ids, queries, k, metric="l2sq"):
    v, out = vectors.astype(np.float64), set()
    for q_id, q in enumerate(queries.astype(np.float64)):
        d = {
            "l2sq": ((v - q) ** 2).sum(1),
            "l2": np.sqrt(((v - q) ** 2).sum(1)),
            "cosine": 1 - v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q)),
            "ip": 1 - v @ q,
        }[metric]
        order = sorted(zip(np.round(d, 4), ids))[:k]
        out |= {(q_id, r, i) for r, (_, i) in enumerate(order, 1)}
    return out


def triples(df):
    return {(r["query_id"], r["rank"], r["id"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine", "ip"])
def test_both_plans_equal_brute_force(spark, data, metric):
    vectors, queries = data
    ids = np.random.default_rng(0).permutation(900).tolist()
    collection = frame(spark, ids, vectors).repartition(7)
    asked = frame(spark, range(len(queries)), queries, name="query_id")
    want = brute_force(vectors, ids, queries, 12, metric)
    assert triples(knn(asked, collection, 12, metric=metric)) == want
    blocks = knn(asked, collection, 12, metric=metric, max_broadcast_queries=5, block_queries=11)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan  # read from what the rounds stored
    assert triples(blocks) == want


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine", "ip"])
def test_balls_give_the_same_rows_and_pass_over_most(metric):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = centres[rng.integers(0, 60, 6000)] + 0.02 * rng.normal(size=(6000, 24))
    vectors[:700] = vectors[0]  # equal copies, more than any k
    vectors[700:703] = 0.0
    queries = np.concatenate([vectors[::97], 3.0 * rng.normal(size=(20, 24)), np.zeros((1, 24))])
    ids = rng.permutation(6000)
    for scale in (1.0, 1e5):
        plain, balls = _Best(scale * queries, 10, metric), _Best(scale * queries, 10, metric)
        for part in np.array_split(np.arange(6000), 2):
            plain.add(ids[part], scale * vectors[part])
            balls.add_by_balls(ids[part], scale * vectors[part])
        if scale == 1.0 or metric == "cosine":
            assert (plain.ids == balls.ids).all() and (plain.distance == balls.distance).all()
        else:  # beyond 15 digits the last decimals depend on the order of the products
            assert np.allclose(plain.distance, balls.distance, rtol=1e-9, atol=1e-2)
    stored = _Best(vectors[::97], 10, metric)
    stored.add_by_balls(ids, vectors)
    print(metric, "distances computed, queries anywhere:", balls.computed / balls.cells, "near stored rows:", stored.computed / stored.cells)
    assert plain.computed == plain.cells and balls.computed < balls.cells and stored.computed < 0.2 * stored.cells


def test_string_ids_and_small_collections(spark, data):
    vectors, queries = data
    ids = [f"chunk_{i}" for i in range(6)]
    collection = frame(spark, ids, vectors[:6], "string")
    asked = frame(spark, range(2), queries[:2], name="query_id")
    assert triples(knn(asked, collection, 50)) == brute_force(vectors[:6], ids, queries[:2], 50)


def test_empty_sides(spark, data):
    vectors, queries = data
    collection, asked = frame(spark, range(5), vectors[:5]), frame(spark, range(2), queries[:2], name="query_id")
    assert knn(asked.where("false"), collection, 3).count() == 0
    assert knn(asked, collection.where("false"), 3).count() == 0
    assert knn(asked, collection, 3, {"id": -1}).count() == 0


def test_filter_comes_before_the_ranking(spark, data):
    vectors, queries = data
    years = ["a" if i % 2 else "b" for i in range(900)]
    collection = frame(spark, range(900), vectors, year=years)
    asked = frame(spark, range(3), queries[:3], name="query_id")
    odd = [i for i in range(900) if i % 2]
    got = knn(asked, collection, 9, {"year": "a"}, columns=("year",))
    assert triples(got) == brute_force(vectors[odd], odd, queries[:3], 9)
    assert {r["year"] for r in got.collect()} == {"a"}


def test_filters(spark):
    df = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(10)], "n int, s string")

    def ids(where):
        return sorted(r["n"] for r in df.where(where_to_column(where)).collect())

    assert ids({"n": 3}) == [3]
    assert ids({"s": "y", "n": {"$gt": 7}}) == [8, 9]
    assert ids({"n": {"$gte": 2, "$lt": 4}}) == [2, 3]
    assert ids({"n": {"$lte": 1}}) == [0, 1] and ids({"n": {"$ne": 1}, "s": "x"}) == [0, 2, 3, 4]
    assert ids({"n": {"$in": [1, 9]}}) == [1, 9] and ids({"n": {"$nin": list(range(9))}}) == [9]
    assert ids({"$or": [{"n": 1}, {"$and": [{"s": "y"}, {"n": {"$eq": 6}}]}]}) == [1, 6]
    assert where_to_column(None) is None and where_to_column({}) is None
    for bad in ({"n": {"$near": 1}}, {"$not": []}, {"s": ["x"]}):
        with pytest.raises(ValueError):
            where_to_column(bad)


def test_filter_is_pushed_to_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "id")
    asked = rows.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding")).withColumnRenamed("label", "query_id")
    plan = knn(asked, rows, 3, {"label": 4})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,4)" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_inner_product_and_similar(spark, data):
    vectors, _ = data
    collection = frame(spark, range(900), vectors)
    items = collection.where("id in (0, 5)")
    got = similar_items(items, collection, 4).collect()
    zero = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == 0)
    assert all(r["id"] != r["query_id"] for r in got) and [r for r, _ in zero] == [1, 2, 3, 4]
    scores = inner_product_top_k(items.withColumnRenamed("id", "query_id"), collection, 3).orderBy("query_id", "rank").collect()
    assert scores[0]["score"] >= scores[1]["score"] >= scores[2]["score"]


def test_dense_index_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"s{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, n int").repartition(5)
    got = dense_index(df, "source", "n", name="i", start=10).collect()
    order = sorted(rows)
    assert sorted((r["i"], r["source"], r["n"]) for r in got) == [(10 + i, s, n) for i, (s, n) in enumerate(order)]


def test_encoder_failures_stay_in_their_batch(spark):
    def load():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot encode")
            return np.ones((len(texts), 3)) / np.sqrt(3)

        return encode

    df = spark.createDataFrame([(i, None if i == 9 else ("bad" if i == 4 else "good")) for i in range(10)], "id int, text string").coalesce(1)
    rows = {r["id"]: r for r in encode_chunks(df, encoder=load, batch_size=2).collect()}
    assert 9 not in rows and len(rows) == 9
    assert rows[4]["embedding"] is None and rows[4]["encode_error"] == "cannot encode" and rows[5]["embedding"] is None
    assert rows[0]["encode_error"] is None and len(rows[0]["embedding"]) == 3


def test_validation(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 0.0],), ([nan, inf],), ([3.0, -inf],), ([1.0],)], "embedding array<float>")
    r = validation_report(df, 4, 2).first()
    assert (r["n_vectors"], r["n_wrong_dimension"], r["n_nan"], r["n_inf"], r["passed"]) == (4, 1, 1, 2, False)
    long = spark.createDataFrame([([3.0, 4.0],), ([0.0, 7.0],)], "embedding array<float>")
    r = validation_report(long, 2, 2).first()
    assert r["passed"] and not r["is_normalised"] and r["mean_norm"] == 6.0 and r["std_norm"] == 1.0
    assert not validation_report(long, 3, 2).first()["passed"]


def test_clusters(spark, data):
    vectors, _ = data
    df = frame(spark, range(900), vectors, year_range=["a"] * 900)
    got = cluster_profile(df, k=4).collect()
    assert sum(r["n_chunks"] for r in got) == 900 and len(got) <= 4


def _lloyd(rows, k, seed, rounds):
    """k-means on whole numbers, one row after the other."""
    import hashlib
    import math

    whole = [tuple(math.floor(float(np.float32(x)) * 65536 + 0.5) for x in r) for r in rows]
    by_hash = sorted({(hashlib.md5(f"{seed}:{','.join(map(str, w))}".encode()).hexdigest(), w) for w in whole})
    centres = [list(w) for _, w in by_hash[:k]]
    near = lambda w: min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(w, centres[c])), c))
    for _ in range(rounds):
        own = [near(w) for w in whole]
        for c in range(len(centres)):
            mine = [w for w, o in zip(whole, own) if o == c]
            if mine:
                centres[c] = [(2 * sum(x) + len(mine)) // (2 * len(mine)) for x in zip(*mine)]
    return [near(w) for w in whole]


def test_kmeans_against_plain_python_in_every_layout(spark):
    from sparquill.operators.clustering import kmeans

    rng = np.random.default_rng(2)
    rows = rng.normal(size=(200, 5)) + 3 * rng.normal(size=(6, 5))[rng.integers(0, 6, 200)]
    rows[150:] = rows[:50]  # copies
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0], [nan] * 5, [inf] + [0.0] * 4, [None] + [0.0] * 4, [1e30] * 5]
    data = list(enumerate([*rows.tolist(), *bad]))
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    want = _lloyd(rows, 4, 42, 6)
    for parts in (1, 7):
        got = {r["id"]: r["cluster"] for r in kmeans(df.repartition(parts), 4, rounds=6).select("id", "cluster").collect()}
        assert [got[i] for i in range(200)] == want and all(got[i] is None for i in range(200, 207))
    few = kmeans(df.where("id < 3"), 10).select("cluster").distinct()
    assert few.count() == 3
    for empty in (df.limit(0), df.where("id = 200")):
        assert {r["cluster"] for r in kmeans(empty).collect()} <= {None}


def test_metadata(spark):
    df = spark.createDataFrame(
        [("a", "2001"), ("a", None), ("b", "2001"), (None, "1999")] * 2, "source_file string, year_range string"
    )
    years = {r["year_range"]: (r["n_chunks"], r["percent"]) for r in M.year_distribution(df).collect()}
    assert years == {"2001": (4, 50.0), "unknown": (2, 25.0), "1999": (2, 25.0)}
    assert M.unique_sources(df).first()[0] == 3
    assert [r[0] for r in M.first_sources(df, 2).collect()] == ["a", "b"]
    assert [r[0] for r in M.distinct_years(df).collect()] == ["1999", "2001", "unknown"]
    left = spark.createDataFrame([(1,), (2,)], "id int")
    assert tuple(M.alignment_report(left, left.where("id = 1"), "id").first()) == (2, 1, 1, False)
    assert M.align(left, left.withColumn("m", F.lit(0)).select("id", "m"), "id").count() == 2
    with pytest.raises(ValueError):
        M.align(left, left.where("id = 1").select("id"), "id")


@pytest.mark.parametrize("max_rows,strategy", [(10, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_small_join_looks_at_the_size(spark, max_rows, strategy):
    side = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k int, v string")
    rows = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).cast("int").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = join_small(rows, side, "k", max_rows)
        assert strategy in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == rows.where("k < 5").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bad_vectors_take_no_part(spark, data):
    """NaN, infinite, null and short vectors on either side, in both plans; a batch may hold nothing else."""
    vectors, queries = data
    spoiled = [v.tolist() for v in vectors]
    spoiled[4][0], spoiled[5][3], spoiled[6][1] = float("nan"), float("inf"), None
    spoiled[7], spoiled[8], spoiled[9] = spoiled[7][:15], None, []
    rows = spark.createDataFrame(list(enumerate(spoiled)), "id long, embedding array<float>")
    asked = [q.tolist() for q in queries] + [[float("nan")] * 16, [1.0] * 3]
    asked = spark.createDataFrame(list(enumerate(asked)), "query_id long, embedding array<float>")
    good = [i for i in range(900) if i not in (4, 5, 6, 7, 8, 9)]
    want = brute_force(vectors[good], good, queries, 5)
    for options in ({}, {"max_broadcast_queries": 0, "block_queries": 16}):
        found = knn(asked, rows, 5, **options).collect()
        assert {(r["query_id"], r["rank"], r["id"]) for r in found} == want
    assert knn(asked, rows.where("id IN (4, 5)"), 5).count() == 0
    counts = unusable_vectors(rows, 16).first()
    assert tuple(counts) == (900, 1, 2, 3)


def test_a_task_compares_large_batches_in_pieces(spark, data, monkeypatch):
    vectors, queries = data
    sizes = []
    monkeypatch.setattr(K, "PIECE_ROWS", 64)
    monkeypatch.setattr(K, "_by_length", lambda ids, column, made=K._by_length: sizes.append(len(column)) or made(ids, column))
    vectors = np.concatenate([vectors, np.full((1, 16), np.nan, np.float32)])
    batch = pa.record_batch({"id": pa.array(range(901)), "embedding": pa.array(list(vectors))})
    best = K._Best(queries.astype(np.float64), 5, "l2sq")
    for piece in K._pieces(iter([batch.slice(1)])):
        for _, places, matrix in K._by_length(K._ids(piece.column(0)), piece.column(1)):
            best.add(K._ids(piece.column(0))[places], matrix)
    assert max(sizes) == 64 and sum(sizes) == 900
    found = {(q, int(i)) for q in range(len(queries)) for i in best.ids[q]}
    assert found == {(q, i) for q, _, i in brute_force(vectors[1:900], range(1, 900), queries, 5)}


def test_texts_are_encoded_once_and_missing_vectors_are_left_out(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "drought and rust"), (2, None), (3, "white mold"), (4, "")], "id int, text string")
    collection = encode_chunks(rows)
    asked = encode_chunks(spark.createDataFrame([("a", "rust"), ("b", "mold"), ("c", None)], "query_id string, text string"))
    found = knn(asked, collection, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {("a", 1), ("b", 3)}
    missing = collection.select("id", F.when(F.col("id") != 1, F.col("embedding")).alias("embedding"))
    for most in (4096, 1):  # both plans
        nearest = {r["query_id"]: r["id"] for r in knn(asked, missing, 1, max_broadcast_queries=most).collect()}
        assert nearest == {"a": 4, "b": 3}
