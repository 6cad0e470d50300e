"""Toxicity scores from subword-bag embeddings and a linear softmax, trained together in numpy.

A word is the mean of the vectors of its character n-grams (3 to 6, and the whole word), so a misspelling
shares most of its vector with the word it comes from.  A window of ``WINDOW`` words is the mean of its
words; a softmax over the window gives its class.  A window begins at every word, so that a phrase counts the same wherever it
stands.  A text scores as its most toxic window, so that one insult counts the same in a note and in a book.

Training sees document labels only: first every window carries its document's label (windows side by side, cut at other
places in each round), then (multiple-instance learning) each toxic document is represented by the window that scores highest, each clean one by its
highest window and a random one.  It runs on a bounded sample of labelled rows; scoring is a map over all texts.
For two classes the gradient of every n-gram vector is a multiple of one direction, which is what the update below uses.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import query, table
from sparquill.llm.tokens import mixed

# The training sample: at most so many rows of either class, by a hash of the id, of texts up to so many bytes.
SAMPLE_TOXIC = 2500
SAMPLE_CLEAN = 6000
SAMPLE_BYTES = 16_384
BUCKETS = 1 << 18
DIMENSIONS = 8
SIZES = (3, 4, 5, 6)
WINDOW = 4  # words; so few, as one toxic word among clean ones must show in the mean
SHORTEST = 2  # a shorter window is filled up with empty words
CLEAN_COST = 1.3  # of rejecting a clean text, against 1 for keeping a toxic one
STEPS = 400  # of multiple-instance training at least, while that takes no more than 40 rounds
MAX_CACHED = 300_000  # words remembered by a worker
BLOCK_WORDS = 100_000  # words of the training texts whose windows are in memory at once

_WORD = re.compile(r"\w+")
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of every word, in which ``<`` and ``>`` mark the ends."""
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - starts[owner]
    whole = np.add.reduceat(mixed(points * _FACTORS[0] + place.astype(np.uint64)), starts)
    owners, grams = [np.arange(len(words))], [mixed(whole)]
    for n in SIZES:
        count = len(points) - n + 1
        if count <= 0:
            continue
        inside = owner[:count] == owner[n - 1 :]
        total = np.zeros(count, dtype=np.uint64)
        for j in range(n):
            total += points[j : j + count] * _FACTORS[j + 1]
        owners.append(owner[:count][inside])
        grams.append(mixed(total[inside] + np.uint64(n)))
    return np.concatenate(owners), (np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _grams_by_word(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one word after the other, and their number for each word."""
    buckets, counts = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
    for at in range(0, len(words), step):
        part = words[at : at + step]
        owner, bucket = subwords(part)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(buckets), np.concatenate(counts)


@dataclass
class Model:
    """The n-gram vectors projected on the softmax direction; that is all that scoring needs."""

    weights: np.ndarray  # one number per bucket
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def word_values(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        bucket, counts = _grams_by_word(words)
        return np.add.reduceat(self.weights[bucket].astype(np.float64), np.cumsum(counts) - counts) / counts

    def logits(self, texts: list[list[str]], cache: dict[str, float]) -> np.ndarray:
        """The highest window of each tokenised text; the bias alone for a text without words."""
        flat = [w for words in texts for w in words]
        new = list({w for w in flat if w not in cache})
        if len(cache) + len(new) > MAX_CACHED:
            cache.clear()
            new = list(set(flat))
        cache.update(zip(new, self.word_values(new).tolist()))
        values = np.fromiter(map(cache.__getitem__, flat), dtype=np.float64, count=len(flat))
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        out = np.full(len(texts), self.bias)
        starts, owner = windows(lengths)
        if len(starts):
            sizes = np.minimum(lengths, WINDOW)[owner]
            scores = window_sums(values, starts, sizes) / np.maximum(sizes, SHORTEST) + self.bias
            firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[firsts]] = np.maximum.reduceat(scores, firsts)
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start (in the words of all texts) and text of each window: one at every word from which ``WINDOW`` words follow, and one
    for a text of fewer words."""
    per_text = np.maximum(lengths - WINDOW + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), per_text)
    before = np.cumsum(lengths - per_text) - (lengths - per_text)  # words of the texts before that begin no window
    return np.arange(len(owner)) + before[owner], owner


def side_by_side(lengths: np.ndarray, phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and text of windows that hold each word once; the first one of a text has ``phase`` words, if that is not 0."""
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - begins[owner]
    starts = np.flatnonzero((place == 0) | ((place - phase[owner]) % WINDOW == 0))
    return starts, owner[starts]


def window_sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each window, the same whatever stands around it (differences of a running sum would not be)."""
    padded = np.append(values, np.zeros(WINDOW, dtype=values.dtype))
    total = np.zeros(len(starts), dtype=values.dtype)
    for j in range(WINDOW):
        total += np.where(j < sizes, padded[starts + j], 0)
    return total


def text_blocks(lengths: np.ndarray, begins: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, behind the last) of texts of about ``BLOCK_WORDS`` words together; a text is never cut."""
    block = begins // BLOCK_WORDS
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    edges = [0, *cuts.tolist(), len(lengths)]
    return list(zip(edges[:-1], edges[1:]))


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Fit on texts with labels 0 and 1; ``prior`` is the share of toxic rows outside the sample.

    Every fourth text of either class is kept back at first, to set scale and threshold on; the vectors are then trained
    again on all texts.
    """
    labels = np.asarray(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(labels.mean() * 8 - 4) if len(labels) else -4.0)
    aside = np.zeros(len(labels), dtype=bool)
    if min(labels.sum(), len(labels) - labels.sum()) >= 40:
        aside[np.argsort(labels, kind="stable")[::4]] = True
    model = train_vectors(texts, labels, np.flatnonzero(~aside), seed)
    rest = np.flatnonzero(aside) if aside.any() else np.arange(len(labels))
    cache: dict[str, float] = {}
    parts = [model.logits([words_of(texts[i]) for i in part], cache) for part in np.array_split(rest, len(rest) // 100 + 1)]
    scale, shift = calibrate(np.concatenate(parts), labels[rest], prior)
    if aside.any():
        model = train_vectors(texts, labels, np.arange(len(labels)), seed)
    model.scale, model.shift = scale, shift
    return model


def train_vectors(texts: list[str], labels: np.ndarray, used: np.ndarray, seed: int) -> Model:
    """Vectors and softmax from the texts at the places ``used``."""
    rng = np.random.default_rng(seed)
    # words as numbers, text by text: the strings of all texts at once would be most of the driver's memory
    vocabulary: dict[str, int] = {}
    numbered = [
        np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(texts[i])), dtype=np.int32) for i in used
    ]
    lengths = np.array([len(n) for n in numbered])
    ids = np.concatenate(numbered) if numbered else np.empty(0, dtype=np.int32)
    del numbered
    known = list(vocabulary)
    del vocabulary
    bucket, counts = _grams_by_word(known)
    first_gram = np.cumsum(counts) - counts
    # windows are known by their first word and made block by block: all at once would be most of the driver's memory
    begins = np.cumsum(lengths) - lengths
    blocks = text_blocks(lengths, begins)
    mark = labels[used].astype(np.int8)
    worded = np.flatnonzero(lengths)
    windows_of = np.maximum(lengths[worded] - WINDOW + 1, 1)

    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    seen, seen_softmax = np.full(BUCKETS, 1e-4), 1e-4  # squared gradients so far

    def bags(start: np.ndarray, size: np.ndarray):
        """Per n-gram of these windows: window, bucket and weight in the window's mean.

        A batch has close to a million n-grams, so what there is one of for each has four bytes where that is enough.
        """
        n = size.astype(np.int64)
        window = np.repeat(np.arange(len(start), dtype=np.int32), n)
        word = ids[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(window))]
        grams = counts[word]
        gram = np.repeat((first_gram[word] - (np.cumsum(grams) - grams)).astype(np.int32), grams)
        gram += np.arange(len(gram), dtype=np.int32)
        weight = 1.0 / (np.maximum(n, SHORTEST)[window] * grams)
        return np.repeat(window, grams), bucket[gram], np.repeat(weight, grams)

    def step(start: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float):
        nonlocal seen_softmax, bias
        window, gram, share = bags(start, size)
        direction = (softmax[:, 1] - softmax[:, 0]).astype(np.float32)
        logit = np.bincount(window, weights=(vectors @ direction)[gram] * share, minlength=len(start)) + bias[1] - bias[0]
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label)
        share *= error[window]
        pull = np.bincount(gram, weights=share, minlength=BUCKETS)
        del window, gram, share
        touched = np.flatnonzero(pull)
        toward = pull[touched] @ vectors[touched]  # the gradient of one softmax column; the other has the opposite sign
        gradient = pull[touched, None] * direction
        seen[touched] += (gradient**2).mean(axis=1)
        vectors[touched] -= rate * gradient / np.sqrt(seen[touched])[:, None]
        seen_softmax += (toward**2).mean()
        move = 0.1 * rate * toward / np.sqrt(seen_softmax)
        softmax[:, 1] -= move
        softmax[:, 0] += move
        shift = 0.5 * rate * error.sum() / max(weight.sum(), 1e-9)
        bias += np.array([shift, -shift])

    def epoch(start: np.ndarray, size: np.ndarray, label: np.ndarray, rate: float):
        toxic = label.mean()
        balance = np.where(label == 1, 0.5 / max(toxic, 1e-9), 0.5 / max(1 - toxic, 1e-9))
        batch = min(8192, max(32, len(start) // 50))
        for part in np.array_split(rng.permutation(len(start)), max(1, len(start) // batch)):
            step(start[part], size[part], label[part], balance[part], rate)

    def direction() -> np.ndarray:
        return (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)

    def tops() -> np.ndarray:
        """The first word of the highest window of each text that has words; of equal ones the last."""
        word_value = np.add.reduceat(direction()[bucket], first_gram) / counts
        found = [np.empty(0, dtype=np.int64)]
        for first, behind in blocks:
            part = lengths[first:behind]
            start, owner = windows(part)
            if not len(start):
                continue
            size = np.minimum(part, WINDOW)[owner]
            values = word_value[ids[begins[first] : begins[first] + part.sum()]]
            logits = (window_sums(values, start, size) / np.maximum(size, SHORTEST)).astype(np.float32)
            firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            highest = np.repeat(np.maximum.reduceat(logits, firsts), np.diff(np.append(firsts, len(start))))
            best = np.flatnonzero(logits == highest)
            best = best[np.append(owner[best[1:]] != owner[best[:-1]], True)]
            found.append(begins[first] + start[best])
        return np.concatenate(found)

    def cut(phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``side_by_side`` over all texts."""
        parts = [side_by_side(lengths[first:behind], phase[first:behind]) for first, behind in blocks]
        return (
            np.concatenate([begins[first] + start for (first, _), (start, _) in zip(blocks, parts)]),
            np.concatenate([first + owner for (first, _), (_, owner) in zip(blocks, parts)]),
        )

    if not len(worded):
        return Model(direction(), float(bias[1] - bias[0]))
    toxic = int(windows_of[mark[worded] == 1].sum())
    share = 2 * toxic / max(1, int(windows_of.sum()) - toxic)  # of the clean windows: two for a toxic one
    rounds = max(6, min(40, STEPS * 32 // len(used)))  # few texts: more rounds over them
    for rate in np.geomspace(0.5, 0.3, max(5, min(10, rounds // 4))):
        # each word once a round, in windows side by side: overlapping ones would show the words at the ends of a text
        # less often than the others, and each toxic word among four times as many clean words of toxic texts
        start, owner = cut(rng.integers(0, WINDOW, len(lengths)))
        size = np.append(start[1:], len(ids)) - start
        label = mark[owner]
        chosen = (label == 1) | (rng.random(len(label)) < share)
        epoch(start[chosen], size[chosen], label[chosen], rate)
    average, average_bias = np.zeros(BUCKETS), 0.0
    for n, rate in enumerate(np.geomspace(0.3, 0.1, rounds)):
        random = begins[worded] + (rng.random(len(worded)) * windows_of).astype(np.int64)
        start = np.unique(np.concatenate((tops(), random[mark[worded] == 0])))
        of = np.searchsorted(begins, start, side="right") - 1  # a text without words never is the last to begin there
        epoch(start, np.minimum(lengths, WINDOW)[of], mark[of], rate)
        if n >= rounds // 2:  # the mean over the second half of the rounds varies less than the last state
            average += direction() / (rounds - rounds // 2)
            average_bias += float(bias[1] - bias[0]) / (rounds - rounds // 2)
    return Model(average.astype(np.float32), average_bias)


def calibrate(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the logits, with classes weighted as outside the sample and by ``CLEAN_COST``."""
    toxic = labels.mean()
    weight = np.where(labels == 1, prior / max(toxic, 1e-9), CLEAN_COST * (1 - prior) / max(1 - toxic, 1e-9))
    middle, spread = logits.mean(), logits.std() or 1.0
    x = np.stack([(logits - middle) / spread, np.ones(len(logits))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps; the ridge keeps the curve finite where the classes part cleanly
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -40, 40)))
        gradient = x @ (weight * (p - labels)) + 0.1 * np.array([beta[0] - 1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))) @ x.T + np.diag([0.1, 1e-6])
        beta = beta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(beta[0] / spread), float(beta[1] - beta[0] * middle / spread)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned; false where the id is null (which no label can name)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Train on labelled rows outside the held-out fifth: at most so many of each class, of texts up to ``sample_bytes``.

    ``labels`` has doc_id and toxic (0, 1; null rows are left out; an id labelled twice is toxic if any row says so).
    Only the text and the label are used.  Texts that are too long are left out before the rows are counted.  Where a class has no
    row left there is nothing to learn: a warning says so, and every text gets one score.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") <= sample_bytes)
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [usable.filter(f"toxic = {y}").orderBy(*order).limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
    chosen = parts[0].union(parts[1])  # bounded by the two limits
    sample = (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")  # an id may repeat
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .toArrow()
        .sort_by("doc_id")
    )
    marks, values = sample["toxic"].to_numpy(), sample["text"].to_pylist()
    del sample
    pa.default_memory_pool().release_unused()  # else Arrow keeps the texts' bytes, twice, through the training
    if len(set(marks.tolist())) < 2:
        warnings.warn(f"no toxicity model: {int((marks == 1).sum())} toxic and {int((marks == 0).sum())} clean texts to learn from", stacklevel=2)
    n = sum(shares.values())
    return train(values, marks, shares.get(1, 0) / n if n else 0.5)


def score(model: Model, text: Column) -> Column:
    """The probability that a text is toxic; null and empty texts score as a text without words."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append(words_of(t))
                size += len(held[-1])
                if size > 100_000:  # words in memory at once
                    out.append(model.logits(held, cache))
                    held, size = [], 0
            out.append(model.logits(held, cache))
            yield pd.Series(model.probability(np.concatenate(out)))

    return run(text)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.  Ids may be null or repeat."""
    scored = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(model, F.col(text_col)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
