"""License scans on a positional index of rare licence words.

The vocabulary of all notices and phrases is small.  A first pass counts in how many documents each of its
words occurs.  Each template (notice or phrase) is indexed under its rarest words only: word -> (template, position).  A
second pass looks the rare words of each text up there; a posting and a place in the text give the place where
the template would begin, and templates that enough of their words confirm at their relative positions are
candidates.  A notice counts if the weight (inverse document frequency) of its words that stand where they should, within
``SLACK`` words, reaches ``LIKE`` and its key phrases are there word by word.  Longer texts are cut into overlapping
windows, each a template of its own, so that what is left of a shortened or altered licence is found.  A phrase counts
only whole, and at every place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import query, table
from sparquill.llm.license_terms import NOTICES, PHRASES, TEXTS
from sparquill.llm.tokens import text_slices, word_hash, words

RARE = 4  # words of a notice in the index
LIKE = 0.8
SLACK = 3
WINDOW = 24  # words of a long text in one template
STRIDE = 12

# Bytes of a word after lower-casing: a-z, 0-9 and everything outside ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True


@dataclass
class Template:
    label: str
    hashes: np.ndarray
    phrase: bool
    required: list[np.ndarray]
    weights: np.ndarray = field(default=None)
    anchors: list[int] = field(default=None)  # positions of the indexed words


def _hashes(text: str) -> np.ndarray:
    return np.array([word_hash(w) for w in text.split()], dtype=np.uint64)


def templates() -> list[Template]:
    phrases = [Template(label, _hashes(text), True, []) for text, label in PHRASES]
    notices = [Template(label, _hashes(text), False, [_hashes(r) for r in required]) for label, text, required in NOTICES]
    return phrases + notices + _windows()


def _runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _windows() -> list[Template]:
    """Templates of the long texts.  A window with key phrases must hold all that its text has; one without them must be
    words of its licence alone: no half of its runs of four words may stand in the text of another label."""
    found = []
    for label, text, required in TEXTS:
        words, keys = text.split(), [r.split() for r in required]
        others = set().union(*(_runs(t.split(), 4) for other, t, _ in TEXTS if other != label))
        last = max(0, len(words) - WINDOW)
        for start in sorted({*range(0, last, STRIDE), last}):
            part = words[start : start + WINDOW]
            held = [tuple(k) in _runs(part, len(k)) for k in keys]
            if all(held):
                found.append(Template(label, _hashes(" ".join(part)), False, [_hashes(r) for r in required]))
            elif not any(held) and 2 * len(_runs(part, 4) & others) < len(_runs(part, 4)):
                found.append(Template(label, _hashes(" ".join(part)), False, []))
    return found


def _found(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
    """Rows and hashes of all words, and the places of those in the sorted vocabulary."""
    rows, hashes = words(data, offsets, LETTERS)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return rows, hashes, at, np.flatnonzero(vocabulary[at] == hashes)


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for first, end, data, offsets in text_slices(batch.column(0)):
                rows, _, at, places = _found(data, offsets, vocabulary)
                pairs = np.unique(rows[places] * len(vocabulary) + at[places])
                counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        word = np.append(np.flatnonzero(counts), -1)  # -1: the documents themselves
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.append(counts[word[:-1]], n))], names=["word", "n"])

    return run


def weigh(docs: DataFrame, text_col: str = "text") -> list[Template]:
    """Templates with the inverse document frequencies of their words in ``docs``, and their rarest words."""
    found = templates()
    vocabulary = np.unique(np.concatenate([t.hashes for t in found]))
    counted = docs.select(text_col).mapInArrow(_frequencies(vocabulary), "word long, n long")
    n = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row per word
    for t in found:
        df = np.array([n.get(int(i), 0) for i in np.searchsorted(vocabulary, t.hashes)])
        t.weights = np.array([math.log((n.get(-1, 0) + 2) / (d + 1)) for d in df])
        rarest = np.argsort(-t.weights, kind="stable")
        t.anchors = [int(i) for i in rarest[: 1 if t.phrase else RARE]]
    return found


def _stands_at(hashes: np.ndarray, starts: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which starts (all in range) have exactly the words of ``run``."""
    whole = np.ones(len(starts), dtype=bool)
    for j, h in enumerate(run):
        whole &= hashes[starts + j] == h
    return whole


def _scan(found: list[Template]):
    vocabulary = np.unique(np.concatenate([t.hashes for t in found]))
    index: dict[int, list[tuple[int, int]]] = {}
    for number, t in enumerate(found):
        for position in t.anchors:
            index.setdefault(int(np.searchsorted(vocabulary, t.hashes[position])), []).append((number, position))
    indexed = np.zeros(len(vocabulary), dtype=bool)
    indexed[list(index)] = True

    def phrases(rows, hashes, rare, at, begins, ends):
        """(row, start, end, label) of every place of every phrase."""
        for word, postings in index.items():
            places = rare[at[rare] == word]
            for number, position in postings:
                t = found[number]
                if not t.phrase or not len(places):
                    continue
                starts = places - position
                row = rows[places]
                inside = (starts >= begins[row]) & (starts + len(t.hashes) <= ends[row])
                starts, row = starts[inside], row[inside]
                whole = _stands_at(hashes, starts, t.hashes)
                for r, s in zip(row[whole], starts[whole]):
                    yield int(r), int(s), int(s) + len(t.hashes), t.label

    def notices(rows, hashes, rare, at, begins, ends):
        """(row, start, end, label, likeness, accepted) of candidate places of notices."""
        votes: dict[tuple[int, int], list[int]] = {}
        for place in rare.tolist():
            for number, position in index[int(at[place])]:
                if not found[number].phrase:
                    votes.setdefault((int(rows[place]), number), []).append(place - position)
        for (row, number), starts in votes.items():
            t, first, last = found[number], int(begins[row]), int(ends[row])
            starts.sort()
            done = None
            for i, start in enumerate(starts):
                near = [s for s in starts[i : i + RARE + 1] if s - start <= SLACK]
                if done is not None and start <= done or len(near) * 2 < len(t.anchors):
                    continue
                low, high = max(first, start - SLACK), min(last, start + SLACK + len(t.hashes) + SLACK)
                region = hashes[low:high]
                place = np.arange(len(t.hashes)) + start - low
                hit = np.zeros(len(t.hashes), dtype=bool)
                for shift in range(-SLACK, SLACK + 1):
                    p = place + shift
                    ok = (p >= 0) & (p < len(region))
                    hit[ok] |= region[p[ok]] == t.hashes[ok]
                like = float(t.weights[hit].sum() / t.weights.sum()) if t.weights.sum() > 0 else float(hit.mean())
                keys = all(
                    len(r) <= len(region) and _stands_at(region, np.arange(len(region) - len(r) + 1), r).any() for r in t.required
                )
                if like >= LIKE and keys:
                    done = start + SLACK
                yield row, max(start, first), min(start + len(t.hashes), last), t.label, min(like, 1.0), like >= LIKE and keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, data, offsets in text_slices(batch.column(1)):
                rows, hashes, at, known = _found(data, offsets, vocabulary)
                n_words = np.bincount(rows, minlength=end - first)
                ends = np.cumsum(n_words)
                begins = ends - n_words
                rare = known[indexed[at[known]]]
                base: dict[int, list] = {}
                spans: dict[int, list] = {}
                best: dict[int, float] = {}
                for r, s, e, label in phrases(rows, hashes, rare, at, begins, ends):
                    base.setdefault(r, []).append((s - int(begins[r]), label))
                    spans.setdefault(r, []).append((s - int(begins[r]), e - int(begins[r]), label))
                    best[r] = 1.0
                for r, s, e, label, like, accepted in notices(rows, hashes, rare, at, begins, ends):
                    best[r] = max(best.get(r, 0.0), like)
                    if accepted:
                        spans.setdefault(r, []).append((s - int(begins[r]), e - int(begins[r]), label))
                for r in range(end - first):
                    places, hits = base.get(r, []), sorted(set(spans.get(r, [])))
                    out.append(
                        (
                            int(n_words[r]),
                            len(places),
                            min(p[0] for p in places) if places else None,
                            max(p[0] for p in places) if places else None,
                            ",".join(sorted({p[1] for p in places})),
                            ",".join(sorted({h[2] for h in hits})),
                            best.get(r, 0.0),
                            ",".join(f"{label}:{s}:{e}" for s, e, label in hits),
                        )
                    )
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return run


_SCHEMA = (
    "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are runs of a-z (A-Z lower-cased), 0-9 and characters outside ASCII; null texts count as empty.  ``n_base`` counts all places
    of the fixed phrases, ``first_word`` and ``last_word`` are the first and last place (words from 0, null without any).
    ``labels`` adds the notices; both lists are distinct, sorted and empty without any.  ``score`` is the likeness of
    the best template, 1 for a phrase.  ``matches`` has label:start:end in words.  Ids may be null or repeat.
    Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    return rows.mapInArrow(_scan(weigh(rows)), schema)


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
