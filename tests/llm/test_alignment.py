"""Token alignment against a walk in plain Python over one document at a time."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparquill.llm import alignment as A
from tests.llm.helpers import awkward, documents, rows


def _brute(texts, folder=A.TOKENIZERS):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, hash), by comparing all byte ranges."""
    a_tok = Tokenizer.from_file(f"{folder}/{A.BYTE_BPE}")
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{A.PIECE_BPE}")
    letters = A.byte_letters()

    def ranges(ids, sizes):
        at, out = 0, []
        for i, n in zip(ids, sizes):
            out.append((at, at + n, i))
            at += n
        return out

    per, links = [], []
    for text in texts:
        text = text or ""
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = b_tok.encode(text)
        bytes_a = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        pieces = [b_tok.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        want = b" " + text.encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            per.append((0, 0, 0, ""))
            links.append([])
            continue
        ra, rb = ranges(a, map(len, bytes_a)), ranges(b, map(len, bytes_b))
        own = [(x[2], y[2]) for x in ra for y in rb if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in ra} & {y[1] for y in rb})
        groups, low = [], 0
        for end in ends:
            ids = lambda r: ",".join(str(i) for s, e, i in r if low <= s and e <= end)  # noqa: E731, B023
            groups.append(f"{ids(ra)}|{ids(rb)}")
            low = end
        per.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    counts = Counter(pair for own in links for pair in set(own))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (n_a, n_b, n_groups, digest), own in zip(per, links):
        out.append((n_a, n_b, n_groups, len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), digest))
    return out


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgé ñß漢🙂") for _ in range(r.randrange(1, 9))) for _ in range(n))


HARD = [
    "<|endoftext|> is plain text", "</s><s><unk>", "a▁b", "  two  blanks ", "\x00\x01", "tab\there\r\n\r\n", "🙂🙂 漢字", "é ﬁ Å", "don't I'll", "1234567890" * 30, " x y",
]


@pytest.fixture(scope="module")
def pair():
    return A.Pair(f"{A.TOKENIZERS}/{A.BYTE_BPE}", f"{A.TOKENIZERS}/{A.PIECE_BPE}")


def _columns(r):
    return tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_rows_against_plain_python(spark):
    values = [_words(i, 30) for i in range(40)] + HARD + [None, "", "same text", "same text"]
    docs = documents(spark, values)
    want = dict(enumerate(_brute(values)))
    for parts, block in ((1, A.BLOCK_BYTES), (5, A.BLOCK_BYTES)):
        got = {r["doc_id"]: _columns(r) for r in rows(A.align_tokenizers(docs.repartition(parts)))}
        assert got == want
    assert want[len(values) - 3] == (0, 0, 0, 0, 0, 0, "")


def test_awkward_rows_and_ids(spark):
    found = rows(A.align_tokenizers(awkward(spark)))
    assert len(found) == 24 and sum(r["doc_id"] is None for r in found) == 2
    ints = documents(spark, ["a b", "c"]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert A.align_tokenizers(ints).schema["doc_id"].dataType.simpleString() == "int" and A.align_tokenizers(ints).count() == 2
    assert A.align_tokenizers(documents(spark, [])).count() == 0


def test_both_forms_of_the_byte_vocabulary_agree(pair):
    assert pair._ranked is not None
    r = random.Random(3)
    letters = [chr(c) for c in range(0x250)]
    texts = [f"a{c}1 {c}{c} b {c}'s{c}\n{c}" for c in letters]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    texts += ["z" * 20_000, " " * 999 + "x", "\n \n" * 300, "don't we'll I'VE", "<|endoftext|>", "".join(letters)]
    whole = [e.ids for e in pair._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert [pair._ranked.encode_ordinary(" " + t) for t in texts] == whole
    hard = ["漢字 x", "x" + " " * 5000 + "y", "plain", "\u2003em"]
    whole = [e.ids for e in pair._a.encode_batch_fast([" " + t for t in hard], add_special_tokens=False)]
    for ids, want in zip(pair.encode(hard)[0], whole):
        assert not len(ids) or ids.tolist() == want


def test_lanes_and_blocks_change_nothing(pair, monkeypatch):
    texts = [_words(7, 900), "z" * 5000, _words(8, 3), "", _words(9, 500)]
    ids = list(zip(*pair.encode(texts)))
    whole = A.Block(pair, ids)
    monkeypatch.setattr(A, "LANE_BYTES", 64)
    lanes = A.Block(pair, ids)
    assert whole.hashes == lanes.hashes and (whole.n_links == lanes.n_links).all() and (whole.places == lanes.places).all()
    assert (whole.codes == lanes.codes).all() and (whole.times == lanes.times).all()
    run, _ = A._aligned(f"{A.TOKENIZERS}/{A.BYTE_BPE}", f"{A.TOKENIZERS}/{A.PIECE_BPE}", "bigint")
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(A, "BLOCK_BYTES", 1000)
    blocks = list(run(iter([batch])))
    assert len(blocks) > 2 and [h for b in blocks for h in b.column("groups_sha256").to_pylist()[1:]] == whole.hashes
