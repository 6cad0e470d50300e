"""Alignment of two tokenizers over the same texts: which tokens overlap, and where both end a token.

Both token sequences of a text cover the same bytes.  Merging them is a walk with one pointer into each: the current tokens overlap,
which is a link; whichever ends first is passed, and where both end at one byte the walk has come to a cut.  Here the walks of all
texts of a slice run in lockstep: two NumPy vectors hold the pointers of all of them, each step emits the links and cuts of every text
that is not finished, and finished ones are taken out of the vectors.  A long text walks in several lanes that begin at cuts, so
that it does not keep the others waiting.

Counting in how many documents a pair of ids is linked goes over blocks of documents of bounded size.  Each task writes the pairs of a
block once, with the number of its documents that hold each, and every document as places in that list.  The corpus-wide
counts are sums over blocks, and go back to the blocks by a join on the pair; then each block's documents are summed up where
its counts have come together.  So a row is shuffled for each pair of a block, not for each link of a document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.llm.common import query, table
from sparquill.llm.tokens import text_slices
from sparquill.session import written

TOKENIZERS = "/opt/tokenizers"  # the same folder on every worker; a parameter of ``align_tokenizers``
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 21  # text of a block of documents; a longer document is a block of its own
CALL_BYTES = 1 << 18  # text handed to a tokenizer at once, as its results are many times as large
LANE_BYTES = 1 << 13  # a longer text walks in several lanes


# Fixed value: how the byte-level vocabulary cuts a text before it merges bytes.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters whose classes may differ between two versions of Unicode, and runs of blanks that are costly to go back over.
_UNSURE = re.compile("[^\x00-\u024f]|\\s{1000}")


class Pair:
    """The two tokenizers with the bytes of each of their ids."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_bpe)
        self._a.encode_special_tokens = True  # their strings inside texts are plain text
        with open(byte_bpe, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        # the same vocabulary as ranks is several times as fast; it is only the same where ids follow the order of merges
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        self._ranked = None
        if merged == sorted(merged) and sorted(set(range(len(self.bytes_a))) - set(merged)) == list(range(256)):
            ranks = {token: i for i, token in enumerate(self.bytes_a)}
            self._ranked = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.bytes_b = [self._piece(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(b) for b in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.texts = [f"{i}{sign}".encode() for i in range(most) for sign in ",|;"]  # an id and what follows it, see ``Block``

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by both; empty ones for texts whose tokens don't give back a space and the text."""
        spaced = [" " + t for t in texts]
        slow = [n for n, t in enumerate(spaced) if self._ranked is None or _UNSURE.search(t)]
        a: list = [None] * len(texts)
        for n, found in zip(slow, self._a.encode_batch_fast([spaced[n] for n in slow], add_special_tokens=False) if slow else []):
            a[n] = found.ids
        a = [self._ranked.encode_ordinary(t) if ids is None else ids for t, ids in zip(spaced, a)]
        b = self._b.encode(texts, num_threads=1)
        for n, text in enumerate(texts):
            want = b" " + text.encode()
            if not text or b"".join(map(self.bytes_a.__getitem__, a[n])) != want or b"".join(map(self.bytes_b.__getitem__, b[n])) != want:
                a[n] = b[n] = []
        # as arrays at once: lists of numbers take ten times as much
        return [np.array(x, dtype=np.int32) for x in a], [np.array(x, dtype=np.int32) for x in b]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printing))
    return {chr(b): b for b in printing} | {chr(0x100 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def _pair(byte_bpe: str, piece_bpe: str) -> Pair:
    return Pair(byte_bpe, piece_bpe)


def lanes_of(ends_a: np.ndarray, ends_b: np.ndarray, n_bytes: int) -> list[tuple[int, int]]:
    """First tokens (A, B) of the lanes of one text, the first one at (0, 0); the others begin at cuts about ``LANE_BYTES`` apart."""
    begins = [(0, 0)]
    target = LANE_BYTES
    while target < n_bytes - LANE_BYTES // 2:
        at = int(np.searchsorted(ends_a, target))
        step, found = 64, False
        while at < len(ends_a) - 1 and not found:  # the first common end from here on
            part = ends_a[at : min(at + step, len(ends_a) - 1)]
            place = np.minimum(np.searchsorted(ends_b, part), len(ends_b) - 1)
            hit = np.flatnonzero(ends_b[place] == part)
            if len(hit):
                begins.append((at + int(hit[0]) + 1, int(place[hit[0]]) + 1))
                target, found = int(part[hit[0]]) + LANE_BYTES, True
            at += step
        if not found:
            break
    return begins


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Walk all lanes at once: links as (A token, B token), cuts as (A token, B token) that end there, by place in the arrays.

    ``ends_a`` and ``ends_b`` are the byte ends of all tokens, lane after lane and ascending; ``a`` and ``b`` the first token of each
    lane, ``last_a`` the token after its last one.
    """
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    a, b = a.copy(), b.copy()
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        links_a.append(a)
        links_b.append(b)
        cut = end_a == end_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        walking = a < last_a
        if not walking.all():  # both sides of a lane end at the same byte
            a, b, last_a = a[walking], b[walking], last_a[walking]
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (links_a, links_b, cuts_a, cuts_b))


class Block:
    """The documents of one block after their walks."""

    def __init__(self, pair: Pair, ids: list[tuple[np.ndarray, np.ndarray]]):
        n = len(ids)
        self.n_a = np.fromiter((len(a) for a, _ in ids), dtype=np.int64, count=n)
        self.n_b = np.fromiter((len(b) for _, b in ids), dtype=np.int64, count=n)
        none = np.empty(0, dtype=np.int32)
        all_a, all_b = np.concatenate([none, *(a for a, _ in ids)]), np.concatenate([none, *(b for _, b in ids)])
        ends_a, ends_b = np.cumsum(pair.size_a[all_a]), np.cumsum(pair.size_b[all_b])
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        begin_a, begin_b = [], []
        for d in range(n):
            if not self.n_a[d]:
                continue
            start = int(ends_a[first_a[d] - 1]) if first_a[d] else 0
            n_bytes = int(ends_a[first_a[d] + self.n_a[d] - 1]) - start
            if n_bytes <= 2 * LANE_BYTES:
                lanes = [(0, 0)]
            else:
                lanes = lanes_of(ends_a[first_a[d] :][: self.n_a[d]] - start, ends_b[first_b[d] :][: self.n_b[d]] - start, n_bytes)
            begin_a += [int(first_a[d]) + x for x, _ in lanes]
            begin_b += [int(first_b[d]) + y for _, y in lanes]
        a, b = np.array(begin_a, dtype=np.int64), np.array(begin_b, dtype=np.int64)
        link_a, link_b, cut_a, cut_b = lockstep(ends_a, ends_b, a, b, np.append(a[1:], len(all_a)) if len(a) else a)
        owner = np.repeat(np.arange(n, dtype=np.int32), self.n_a)
        self.n_links = np.bincount(owner[link_a], minlength=n)
        self.n_groups = np.bincount(owner[cut_a], minlength=n)
        self.hashes = self._hashes(pair, all_a, all_b, np.sort(cut_a), np.sort(cut_b))
        # what a document links, each pair of ids once with its number of links
        who, codes = owner[link_a], all_a[link_a].astype(np.int64) * len(pair.size_b) + all_b[link_b]
        del link_a, link_b, cut_a, cut_b
        order = np.lexsort((codes, who))
        who, codes = who[order], codes[order]
        runs = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (codes[1:] != codes[:-1])))) if len(codes) else order
        self.times = np.diff(np.append(runs, len(codes))).astype(np.int32)
        self.of = np.bincount(who[runs], minlength=n) if len(runs) else np.zeros(n, dtype=np.int64)
        self.codes, places, self.documents = np.unique(codes[runs], return_inverse=True, return_counts=True)
        self.places = places.astype(np.int32)

    def _hashes(self, pair: Pair, all_a: np.ndarray, all_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """The hash of each document's groups.  Every id is written with the sign after it: ``,`` inside a group, ``|`` after the last A
        token of one, ``;`` after its last B token; a group's A tokens stand before its B tokens."""
        in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)  # tokens of each group
        written = np.empty(len(all_a) + len(all_b), dtype=np.int32)
        sign = np.zeros(len(all_a), dtype=np.int32)
        sign[cut_a] = 1
        written[np.arange(len(all_a)) + np.repeat(cut_b + 1 - in_b, in_a)] = all_a * np.int32(3) + sign
        sign = np.zeros(len(all_b), dtype=np.int32)
        sign[cut_b] = 2
        written[np.arange(len(all_b)) + np.repeat(cut_a + 1, in_b)] = all_b * np.int32(3) + sign
        out, ends = [], np.cumsum(self.n_a + self.n_b)
        for end, size in zip(ends.tolist(), (self.n_a + self.n_b).tolist()):
            text = b"".join(map(pair.texts.__getitem__, written[end - size : end].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if size else "")
        return out

    def rows(self) -> Iterator[tuple[int, int, int, int, str, bytes, bytes]]:
        """Per document its figures, and as bytes the steps between its places in ``codes`` and its numbers of links."""
        ends = np.cumsum(self.of)
        for d in range(len(self.of)):
            part = slice(int(ends[d] - self.of[d]), int(ends[d]))
            steps = np.diff(self.places[part], prepend=np.int32(0))
            yield int(self.n_a[d]), int(self.n_b[d]), int(self.n_groups[d]), int(self.n_links[d]), self.hashes[d], steps.tobytes(), self.times[part].tobytes()


def _aligned(byte_bpe: str, piece_bpe: str, key_type: str):
    """Task function: (key, text) rows to one row per document and, in front of them, one row per block with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_bpe, piece_bpe)
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        for batch in batches:
            texts = batch.column(1)
            for first, end, _, _ in text_slices(texts, BLOCK_BYTES):
                ids: list[tuple[np.ndarray, np.ndarray]] = []
                for low, high, _, _ in text_slices(texts.slice(first, end - first), CALL_BYTES):
                    a, b = pair.encode([t or "" for t in texts.slice(first + low, high - low).to_pylist()])
                    ids += zip(a, b)
                found = Block(pair, ids)
                documents = list(zip(*found.rows()))
                keys = pa.concat_arrays([pa.nulls(1, batch.column(0).type), batch.column(0).slice(first, end - first)])
                whole = [None, None, None, None, None, found.codes.tobytes(), found.documents.astype(np.int32).tobytes()]
                types = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                columns = [pa.array([w, *c], t) for w, c, t in zip(whole, documents, types)]
                n = end - first + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array([True] + [False] * (n - 1)), keys, *columns],
                    names=["block", "is_block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"],
                )
                block += 1

    schema = f"block long, is_block boolean, doc_id {key_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"
    return run, schema


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, codes, documents in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            codes, documents = np.frombuffer(codes, dtype=np.int64), np.frombuffer(documents, dtype=np.int32).astype(np.int64)
            for at in range(0, len(codes), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes[part]), block)), pa.array(codes[part]), pa.array(documents[part])],
                    names=["block", "code", "documents"],
                )


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """One block: its documents and the corpus-wide count of each of its pairs."""
    counts = counts.sort_by("code")
    count = counts["documents"].to_numpy()
    best = counts["is_best"].to_numpy(zero_copy_only=False).astype(np.int64)
    places, times = documents["places"].to_pylist(), documents["times"].to_pylist()
    n_best, total = [], []
    for p, t in zip(places, times):
        at, t = np.cumsum(np.frombuffer(p, dtype=np.int32)), np.frombuffer(t, dtype=np.int32).astype(np.int64)
        n_best.append(int((best[at] * t).sum()))
        total.append(int((count[at] * t).sum()))
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    kept = kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
    return kept.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens don't give back the text, have zeros and an empty hash; they count for no pair.
    Rows that repeat an id are documents of their own.  Ids may be null and of any type; other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()
    run, schema = _aligned(f"{folder}/{BYTE_BPE}", f"{folder}/{PIECE_BPE}", key_type)
    stored = written(rows.mapInArrow(run, schema))
    in_blocks = stored.filter("is_block").select("block", "places", "times").mapInArrow(_pairs_of_blocks, "block long, code long, documents long")
    counts = in_blocks.groupBy("code").agg(F.sum("documents").alias("documents"))
    size_b = _pair(f"{folder}/{BYTE_BPE}", f"{folder}/{PIECE_BPE}").size_b
    of_a = W.partitionBy(F.expr(f"code div {len(size_b)}"))  # at most as many rows as B has ids
    counts = counts.withColumn("is_best", F.col("documents") == F.max("documents").over(of_a))
    known = in_blocks.select("block", "code").join(counts, "code")
    out = f"doc_id {key_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    documents = stored.filter("NOT is_block").drop("is_block")
    return documents.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, out)


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
