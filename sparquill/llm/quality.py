"""Quality scores from a generalised additive model with pairwise interactions, fitted by cyclic boosting in numpy.

A text is described by ``FEATURES``, numbers about its letters, words and lines that are computed over its whole bytes as array work.
Each feature is cut into at most ``BINS`` bins at quantiles of the sample.  Boosting goes round the features: one shallow tree on
one feature at a time, so that the trees of a feature add up to a table with one number per bin.  The pairs of
features whose product grid explains most of what is left get tables over two features in the same way.  A score is the
logistic function of a constant plus one looked-up number for each table, so scoring is additions of bins.

Fitting sees a bounded sample of labelled rows.  Their features are computed by tasks; only those numbers reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import query, table
from sparquill.llm.tokens import NOT_BLANK, text_slices, words

FEATURES = (
    "bytes", "words", "word length", "upper case", "digits", "marks", "symbols", "outside ASCII", "blanks", "words without letters",
    "distinct words", "most frequent word", "words repeated at once", "distinct triples", "distinct lines", "words a line", "short words", "lower-case beginnings",
)

SAMPLE_ROWS = 6000  # of either class, by a hash of the id
BINS = 48
PAIR_BINS = 12
PAIRS = 8
ROUNDS = 160
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 3
LEAST_WEIGHT = 8.0  # sum of weights in a leaf; rare values get no table entry of their own
RIDGE = 4.0

_LETTER, _UPPER, _DIGIT, _MARK, _SYMBOL, _OTHER, _BLANK, _CONTROL = range(8)
_CLASS = np.full(256, _CONTROL, dtype=np.uint8)
_CLASS[33:127] = _SYMBOL
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LETTER
_CLASS[~NOT_BLANK] = _BLANK
_CLASS[128:] = _OTHER
_IN_LINE = np.ones(256, dtype=bool)
_IN_LINE[10] = False


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how many different keys it has and how often the most frequent one occurs."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
    sizes = np.diff(np.append(first, len(r)))
    most = np.zeros(n)
    np.maximum.at(most, r[first], sizes)
    return np.bincount(r[first], minlength=n).astype(float), most


def slice_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) for the texts that stand one after the other in ``data``."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    kinds = _CLASS[data]
    per = np.zeros((n, 8))
    full = np.flatnonzero(sizes)
    for c in range(8):
        if len(full):
            per[full, c] = np.add.reduceat(kinds == c, offsets[:-1][full], dtype=np.int64)
    rows, hashes = words(data, offsets)
    inside = NOT_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])) if len(data) else np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if len(data) else starts
    count = np.bincount(rows, minlength=n).astype(float)
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    per_word = lambda flag: np.bincount(rows, weights=flag, minlength=n)

    letters = np.concatenate(([0], np.cumsum((kinds == _LETTER) | (kinds == _UPPER) | (kinds == _OTHER))))
    same = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
    different, most = _distinct(rows, hashes, n)
    triple = np.flatnonzero(rows[2:] == rows[:-2])
    key = hashes[triple] * np.uint64(3) + hashes[triple + 1] * np.uint64(5) + hashes[triple + 2] * np.uint64(7)
    triples, _ = _distinct(rows[triple], key, n)
    line_rows, line_hashes = words(data, offsets, _IN_LINE)
    lines = np.bincount(line_rows, minlength=n).astype(float)
    different_lines, _ = _distinct(line_rows, line_hashes, n)
    in_words = sizes - per[:, _BLANK]
    return np.stack(
        [
            np.log1p(sizes),
            np.log1p(count),
            share(in_words, count),
            share(per[:, _UPPER], per[:, _UPPER] + per[:, _LETTER]),
            share(per[:, _DIGIT], in_words),
            share(per[:, _MARK], in_words),
            share(per[:, _SYMBOL] + per[:, _CONTROL], in_words),
            share(per[:, _OTHER], in_words),
            share(per[:, _BLANK], sizes),
            share(per_word(letters[ends] == letters[starts]), count),
            share(different, count),
            share(most, count),
            share(np.bincount(rows[1:][same], minlength=n).astype(float), count),
            share(triples, np.maximum(count - 2, 0)),
            share(different_lines, lines),
            np.log1p(share(count, lines)),
            share(per_word(ends - starts <= 3), count),
            share(per_word(kinds[starts] == _LETTER), count),
        ],
        axis=1,
    )


def features(texts: pa.Array) -> np.ndarray:
    """(texts, features); null texts count as empty."""
    parts = [slice_features(data, offsets) for _, _, data, offsets in text_slices(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)))


@dataclass
class Model:
    """Cuts of each feature, one table per feature, and tables over pairs of features with coarser cuts."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cut, x[:, j], side="right")]
        if self.pairs:
            used = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
            for (i, j), values in self.pairs.items():
                total += values[used[i], used[j]]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Values that part the sample into at most ``bins`` bins of about equal counts; equal values stay together."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """One value per bin: the best tree of so many leaves over ordered bins, grown greedily, with Newton steps at the leaves."""
    g, h = np.cumsum(gradient), np.cumsum(hessian)
    total = lambda s, a, b: s[b - 1] - (s[a - 1] if a else 0)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for n, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = g[a : b - 1] - (g[a - 1] if a else 0), h[a : b - 1] - (h[a - 1] if a else 0)
            all_g, all_h = total(g, a, b), total(h, a, b)
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            gain[(left_h < LEAST_WEIGHT / 4) | (all_h - left_h < LEAST_WEIGHT / 4)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), n, a + at + 1)
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = -total(g, a, b) / (total(h, a, b) + RIDGE)
    return out


def shallow_grid(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """A tree over two features: the best cut of one of them, then each side cut by the other one."""
    best, grid = -1.0, np.zeros_like(gradient)
    for turn in (False, True):
        g, h = (gradient.T, hessian.T) if turn else (gradient, hessian)
        left_g, left_h = np.cumsum(g, axis=0)[:-1], np.cumsum(h, axis=0)[:-1]
        sides = [(left_g, left_h), (g.sum(axis=0) - left_g, h.sum(axis=0) - left_h)]
        gains, places = np.zeros(len(left_g)), []
        for side_g, side_h in sides:
            cum_g, cum_h = np.cumsum(side_g, axis=1), np.cumsum(side_h, axis=1)
            rest_g, rest_h = cum_g[:, -1:] - cum_g, cum_h[:, -1:] - cum_h
            gain = _gain(cum_g, cum_h) + _gain(rest_g, rest_h)
            places.append(np.argmax(gain, axis=1))
            gains += gain[np.arange(len(gain)), places[-1]]
        if len(gains) and gains.max() > best:
            best, at = float(gains.max()), int(np.argmax(gains))
            out = np.zeros_like(g)
            for rows, (side_g, side_h), place in zip((slice(0, at + 1), slice(at + 1, None)), sides, places):
                for columns in (slice(0, place[at] + 1), slice(place[at] + 1, None)):
                    sum_g, sum_h = side_g[at, columns].sum(), side_h[at, columns].sum()
                    out[rows, columns] = -sum_g / (sum_h + RIDGE)
            grid = out.T if turn else out
    return grid


def train(x: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """Fit on features and labels 0 and 1; ``prior`` is the share of label 1 outside the sample, as rows are weighted to match it."""
    labels = np.asarray(labels, dtype=float)
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    start = float(np.log(prior / (1 - prior)))
    if not len(labels) or labels.min() == labels.max():
        return Model(start)
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    n_features = x.shape[1]
    cuts = [_quantile_cuts(x[:, j], BINS) for j in range(n_features)]
    bins = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(n_features)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    logit = np.full(len(x), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return weight * (p - labels), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n_features):  # one small step per feature, in turn
            g, h = slopes()
            size = len(tables[j])
            tree = RATE * np.clip(shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size)), -4, 4)
            tables[j] += tree
            logit += tree[bins[j]]

    coarse = [_quantile_cuts(x[:, j], PAIR_BINS) for j in range(n_features)]
    cells = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(n_features)]

    def grid_sums(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    explained = []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            sums_g, sums_h = grid_sums(i, j, g), grid_sums(i, j, h)
            explained.append((float((-shallow_grid(sums_g, sums_h) * sums_g).sum()), i, j))
    chosen = [(i, j) for gain, i, j in sorted(explained, reverse=True)[:PAIRS] if gain > 0]
    pairs = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slopes()
            tree = RATE * np.clip(shallow_grid(grid_sums(i, j, g), grid_sums(i, j, h)), -4, 4)
            pairs[i, j] += tree
            logit += tree[cells[i], cells[j]]
    # each table gets mean 0 over the sample, so that the constant is the mean logit
    intercept = start
    for values, of in zip(tables, bins):
        mean = float(np.average(values[of], weights=weight))
        values -= mean
        intercept += mean
    for (i, j), values in pairs.items():
        mean = float(np.average(values[cells[i], cells[j]], weights=weight))
        values -= mean
        intercept += mean
    return Model(intercept, cuts, tables, coarse, pairs)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned; false where the id is null (which no label can name)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled rows outside the held-out fifth, at most ``sample_rows`` of either class; whole texts of any length.

    ``labels`` has doc_id and quality (0, 1; null rows are left out; an id labelled twice is good if no row says otherwise).
    Only the text and the label are used.  Where a class has no row there is nothing to learn: a warning says so, and every text gets one score.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [usable.filter(f"quality = {y}").orderBy(*order).limit(sample_rows) for y in (0, 1)]
    chosen = parts[0].union(parts[1])  # bounded by the two limits

    @F.arrow_udf("array<double>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(features(batch).tolist(), pa.list_(pa.float64()))

    sample = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", described("text").alias("x"))
        .groupBy("doc_id")  # an id may repeat
        .agg(F.min("x").alias("x"), F.min("quality").alias("quality"))
        .toArrow()
        .sort_by("doc_id")
    )
    marks = sample["quality"].to_numpy()
    if len(set(marks.tolist())) < 2:
        warnings.warn(f"no quality model: {int((marks == 1).sum())} good and {int((marks == 0).sum())} poor texts to learn from", stacklevel=2)
    x = np.array(sample["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    n = sum(shares.values())
    return train(x, marks, shares.get(1, 0) / n if n else 0.5)


def score(model: Model, text: Column) -> Column:
    """The probability that a text is good; null and empty texts have their features all 0."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.probability(features(batch)), pa.float64())

    return run(text)


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from ``keep_from`` on).

    Ids may be null, repeat, and be of any type.  Other columns are neither read nor returned.
    """
    scored = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(model, F.col(text_col)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


@query("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))
