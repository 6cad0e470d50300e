"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

* **Sketch.** One pass hashes the word shingles of each text.  The top bits of a hash choose one of
  ``REGISTERS`` buckets; of the smallest hash in a bucket only the count of leading zeros and a
  few bits after the leading one are kept (two bytes).
* **Classes.** Texts with the same shingle set are one class from here on, so thousands of
  exact copies cost one sketch.
* **Candidates.** The compressed registers are cut into bands (empty ones borrow from filled
  ones first); classes that agree in a whole band share a bucket, whose smallest class is its leader.
* **Stars.** First every class meets the leader it shares most buckets with.  Pairs whose collision-corrected Jaccard
  estimate lies five standard deviations under the threshold are left out, all others are compared on their
  full shingle sets.  The links make components.
* **The rest.** Only classes of one bucket in different components may still be linked.  All that share a bucket
  with the same leader form a group.  Where a group holds several components, the classes outside
  its largest one are compared with all others on their full sets, by counting common shingles through an inverted index
  inside a task; groups are cut into cells of bounded size, and a cell returns no more than the links
  that join components.  So pairs of a large group are never rows.

With 51 bands of five registers a link at the threshold itself escapes all bands with a chance of 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import query, table
from sparquill.llm.components import components
from sparquill.llm.tokens import mixed, text_slices, words
from sparquill.session import checkpointed

SHINGLE = 5
SIMILAR = 75  # per cent
REGISTERS = 256
MANTISSA = 10  # bits kept after the leading one
BANDS, ROWS = 51, 5
CELL = 1 << 19  # shingles compared in one task at most, apart from the size of a single document
MAX_BROADCAST_IDS = 1 << 20  # 8 bytes each

_rng = np.random.default_rng(5)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BORROW = _rng.random((REGISTERS, REGISTERS))
# Expected share of registers that agree by chance, for sets of like size (times 2**-MANTISSA).
_CHANCE = 0.169919487159739093975315012348630288992051


# -- inside a task ------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``k`` words; of all words where a row has fewer."""
    rows, hashes = words(data, offsets)
    n = max(len(rows) - k + 1, 0)
    whole = rows[:n] == rows[k - 1 :] if n else np.empty(0, dtype=bool)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j]
    where, found = rows[:n][whole], mixed(total[whole])
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        firsts = np.searchsorted(rows, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += hashes[firsts[has] + j] * _PLACE[j]
        extra = mixed(extra + counts[short].astype(np.uint64) * _PLACE[k])
        where, found = np.concatenate((where, short)), np.concatenate((found, extra))
        order = np.argsort(where, kind="stable")
        where, found = where[order], found[order]
    return where, found


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in text_slices(texts):
        where, found = shingles(data, offsets, k)
        cuts = np.searchsorted(where, np.arange(end - first + 1))
        for i in range(end - first):
            yield np.unique(found[cuts[i] : cuts[i + 1]])


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes; 0 marks an empty bucket."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))  # sorted: the bucket's smallest
    rest = (hashes[first] >> np.uint64(4)) & np.uint64(2**52 - 1)
    zeros = 52 - np.frexp(rest.astype(np.float64))[1]
    tail = (rest << zeros.astype(np.uint64)) >> np.uint64(51 - MANTISSA) & np.uint64(2**MANTISSA - 1)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[bucket[first]] = (zeros << MANTISSA | tail.astype(np.int64)) + 1
    return out


def borrowed(sketch: np.ndarray) -> np.ndarray:
    """Empty buckets take the register of the filled bucket that comes first in their own fixed random order."""
    full = np.flatnonzero(sketch)
    empty = np.flatnonzero(sketch == 0)
    if not len(empty) or not len(full):
        return sketch
    out = sketch.copy()
    out[empty] = sketch[full[_BORROW[empty][:, full].argmin(axis=1)]]
    return out


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, dense, used = [], [], [], []
            for hashes in shingle_sets(batch.column(1), k):
                n.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sketch = registers(hashes) if len(hashes) else np.zeros(REGISTERS, dtype=np.uint16)
                dense.append(borrowed(sketch).tobytes())
                used.append(np.packbits(sketch > 0).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(dense, pa.binary()), pa.array(used, pa.binary())],
                names=["doc_id", "n", "digest", "dense", "used"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "shingles"])

    return run


def _estimates(similar: int):
    """Keep pairs that may be similar, by registers that agree beyond chance."""

    def unpack(column: pa.Array, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = unpack(batch.column("dense_a"), np.uint16), unpack(batch.column("dense_b"), np.uint16)
            in_a = np.unpackbits(unpack(batch.column("used_a"), np.uint8), axis=1).astype(bool)
            in_b = np.unpackbits(unpack(batch.column("used_b"), np.uint8), axis=1).astype(bool)
            either = (in_a | in_b).sum(axis=1)
            equal = ((a == b) & in_a & in_b).sum(axis=1)
            ratio = batch.column("n_a").to_numpy() / batch.column("n_b").to_numpy()
            chance = either * _CHANCE * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
            estimate = (equal - chance) / either
            t = similar / 100
            keep = (either < 64) | (estimate >= t - 5 * np.sqrt(t * (1 - t) / either))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _cell_links(similar: int):
    """Links between a cell's strays and its members of other components, no more than join components."""

    def run(cell: pa.Table) -> pa.Table:
        component = cell["component"].to_numpy()
        lists = cell["shingles"].combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        flat = lists.flatten().to_numpy()
        n = np.diff(ends)
        member = np.flatnonzero(cell["member"].to_numpy())
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.isin(owner, member)
        order = np.argsort(flat[inside], kind="stable")
        keys, holders = flat[inside][order], owner[inside][order]
        parent = {int(c): int(c) for c in component}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b = [], []
        for x in np.flatnonzero(cell["stray"].to_numpy()):
            mine = flat[ends[x] : ends[x + 1]]
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            counts = high - low
            places = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            common = np.bincount(holders[places], minlength=len(n))
            for y in np.flatnonzero((common > 0) & (100 * common >= similar * (n + n[x] - common))):
                p, q = top(int(component[x])), top(int(component[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(int(component[x]))
                    b.append(int(component[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


# -- the plan -----------------------------------------------------------------


def _near_size(a: Column, b: Column, similar: int) -> Column:
    """Only sets of like size can be similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similar


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents with these ids, from their texts."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return texts.mapInArrow(_sets(k), "id long, shingles array<long>")


def _confirm(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, similar: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full shingle sets are similar."""
    for side in ("a", "b"):
        renamed = {"class_id": side, "n": f"n_{side}", "dense": f"dense_{side}", "used": f"used_{side}"}
        pairs = pairs.join(sketches.withColumnsRenamed(renamed), side)
    likely = checkpointed(pairs.mapInArrow(_estimates(similar), "a long, b long"))
    ids = checkpointed(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
    sets = _sets_of(ids, docs, k)
    both = likely.join(sets.withColumnsRenamed({"id": "a", "shingles": "s_a"}), "a")
    both = both.join(sets.withColumnsRenamed({"id": "b", "shingles": "s_b"}), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return both.filter(common * 100 >= union * similar).select("a", "b").distinct()


def _bridges(groups: DataFrame, docs: DataFrame, k: int, similar: int) -> DataFrame:
    """Links (a, b) between components, from groups (leader, class_id, n, component)."""
    sizes = groups.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    main = F.max(F.struct("size", "component", "words")).alias("main")
    mixed_groups = sizes.groupBy("leader").agg(F.count(F.lit(1)).alias("parts"), F.sum("words").alias("words"), main).filter("parts > 1")
    cut = checkpointed(mixed_groups.select(  # stored, so that adaptive execution can split what it meets
        "leader",
        F.col("main.component").alias("main"),
        F.ceil(F.col("words") / CELL).alias("columns"),
        F.ceil((F.col("words") - F.col("main.words")) / CELL).alias("lines"),
    ))
    rows = groups.join(cut, "leader").withColumn("stray", F.col("component") != F.col("main"))
    # every class is in one column, every stray also in one line; a cell compares its strays with its column
    rows = rows.withColumn("column", F.pmod(F.xxhash64("class_id"), "columns")).withColumn("line", F.pmod(F.xxhash64("class_id"), "lines"))
    down = F.transform(F.sequence(F.lit(0), F.col("lines") - 1), lambda i: F.struct(i.cast("long").alias("i"), F.col("column").alias("j")))
    along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("line").alias("i"), j.cast("long").alias("j")))
    cells = rows.withColumn("cell", F.explode(F.when(F.col("stray"), F.array_union(down, along)).otherwise(down)))
    cells = checkpointed(
        cells.select(
            "leader", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), F.col("class_id").alias("id"), "component",
            (F.col("column") == F.col("cell.j")).alias("member"), (F.col("stray") & (F.col("line") == F.col("cell.i"))).alias("stray"),
        )
    )
    sets = _sets_of(checkpointed(cells.select("id").distinct()), docs, k)
    return cells.join(sets, "id").groupBy("leader", "i", "j").applyInArrow(_cell_links(similar), "a long, b long").distinct()


def _several_texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class_id) of the documents whose rows have several shingle sets, of which one may be empty."""
    known = rows.filter("doc_id IS NOT NULL").select("doc_id", "digest")
    ids = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high").select("doc_id")
    few = known.join(checkpointed(ids), "doc_id", "left_semi").distinct()
    return checkpointed(few.join(classes.select("digest", "class_id"), "digest").select("doc_id", "class_id"))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similar: int = SIMILAR
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a set has the distinct runs of ``k`` words, or
    the whole text's words where there are fewer.  Null, empty and blank texts have no set and are linked with nothing.
    ``component_id`` is the smallest id reachable over links; ``kept`` marks the document with that id.  Rows that repeat an id are
    one document, with the links of all its texts.  A null id is linked with nothing: its component is null and it is kept.
    Other columns are neither read nor returned.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = checkpointed(
        texts.mapInArrow(_sketches(k), "doc_id long, n long, digest binary, dense binary, used binary")
    )
    linked = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes)
    first = classes.select("digest", F.col("class_id").alias("doc_id"))
    sketches = linked.join(first, ["digest", "doc_id"], "left_semi")
    sketches = checkpointed(sketches.select(F.col("doc_id").alias("class_id"), "n", "dense", "used"))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    members = sketches.select("class_id", "n", band, "dense").select(
        "class_id", "n", F.xxhash64("band", F.expr(f"substring(dense, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key")
    )
    leader = F.min(F.struct("class_id", "n")).alias("leader")
    buckets = members.groupBy("key").agg(leader, F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = checkpointed(members.join(buckets.select("key", "leader"), "key"))  # members of real buckets only

    votes = (
        shared.filter((F.col("class_id") != F.col("leader.class_id")) & _near_size(F.col("n"), F.col("leader.n"), similar))
        .groupBy(F.col("class_id").alias("a"), F.col("leader.class_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    best = votes.groupBy("a").agg(F.max(F.struct("votes", -F.col("b"))).alias("best"))
    stars = best.select("a", (-F.col("best.col2")).alias("b"))
    links = _confirm(stars, sketches, texts, k, similar)
    several = _several_texts(rows, classes)
    repeats = not several.isEmpty()
    if repeats:  # a document with several texts links their classes
        lowest = several.groupBy("doc_id").agg(F.min("class_id").alias("b"))
        links = links.union(several.join(lowest, "doc_id").filter("class_id != b").select(F.col("class_id").alias("a"), "b").distinct())
    labels = checkpointed(components(links))

    # what may still be linked: classes under one leader in several components
    named = labels.select(F.col("node").alias("class_id"), "component")
    groups = shared.select(F.col("leader.class_id").alias("leader"), "class_id", "n").distinct().join(named, "class_id", "left")
    groups = checkpointed(groups.withColumn("component", F.coalesce("component", "class_id")))
    bridges = _bridges(groups, texts, k, similar)
    merged = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("final"))
    settled = classes.join(named, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    settled = settled.join(merged, "component", "left").withColumn("component_id", F.coalesce("final", "component"))
    verdicts = settled.filter("copies > 1 OR component_id != class_id").select("digest", "component_id")
    found = rows.select("doc_id", "n", "digest").join(verdicts, "digest", "left")
    if repeats:  # its blank texts, which have no class, go with the others
        own = several.join(settled.select("class_id", F.col("component_id").alias("own_id")).distinct(), "class_id")
        own = own.groupBy("doc_id").agg(F.min("own_id").alias("own_id"))
        found = found.join(own, "doc_id", "left").withColumn("component_id", F.coalesce("own_id", "component_id"))
    linked_id = (F.col("n") > 0) | F.col("own_id").isNotNull() if repeats else F.col("n") > 0
    component = F.when(linked_id & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns that stay: one row of each component, and all rows without id."""
    verdicts = checkpointed(near_dedup(docs, id_col, text_col))
    gone = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    repeated = verdicts.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    repeated = checkpointed(repeated.select(F.col("doc_id").alias(id_col)))
    stay = docs.join(checkpointed(gone), id_col, "left_anti")
    if not repeated.isEmpty():  # rows that share an id: one of them, which takes a shuffle of these rows
        once = stay.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
        stay = stay.join(repeated, id_col, "left_anti").unionByName(once)
    return stay.select(*docs.columns)


@query(
    "op3_minhash_near_dedup",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (s)
                    WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 75 * (na.n + nb.n - p.i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
