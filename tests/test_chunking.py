"""The fold against an independent plain-Python reading of its specification."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.operators.chunking import chunk_documents, fold_plain, fold_sections


def tokens(text):
    return len(text) // 4


def tail(text, n):
    return text[-4 * n:] if n else ""


def header(line):
    for name, pattern in vocab.SECTION_PATTERNS:
        if re.fullmatch(pattern, line.strip(), re.IGNORECASE):
            return name
    return None


def table_like(line):
    return "|" in line or (len(line.strip()) > 10 and re.search(r"\S\s{3,}\S", line) is not None)


def units(marked, with_layout):
    """Yield (page, kind, text): kind is 'table' or 'sentence'."""
    parts = re.split(r"\[PAGE (\d+)\]", marked)[1:]
    for page, body in zip(map(int, parts[::2]), parts[1::2]):
        if not with_layout:
            pieces = [("sentence", body)]
        else:
            pieces, run = [], []
            for line in body.split("\n") + [None]:
                if line is not None and table_like(line):
                    run.append(line)
                    continue
                if run:
                    pieces.append(("table", "\n".join(run)))
                    run = []
                if line is not None:
                    pieces.append(("sentence", line))
        for kind, content in pieces:
            found = [content] if kind == "table" else re.split(r"(?<=[.!?])\s+", content.strip())
            for text in found:
                if text.strip():
                    yield page, kind, text.strip()


def expected_sections(marked, size, overlap):
    chunks, current, count, section, last_page = [], "", 0, "", 1
    for page, kind, text in units(marked, True):
        last_page = page
        new_section = header(text) if kind == "sentence" else None
        breaks = kind == "table" or new_section
        overflow = not breaks and current and count + tokens(text) > size
        if current and (breaks or overflow):
            chunks.append((current, page, count, section))
        if kind == "table":
            chunks.append((text, page, tokens(text), section))
        if breaks:
            current, count, section = "", 0, new_section or section
        elif overflow:
            current = (tail(current, overlap) + " " + text).strip()
            count = tokens(current)
        else:
            current = f"{current} {text}" if current else text
            count += tokens(text)
    return chunks + ([(current, last_page, count, section)] if current else [])


def expected_plain(marked, size, overlap):
    chunks, current, count, last_page = [], "", 0, 1
    for page, _, text in units(marked, False):
        if current and count + tokens(text) > size:
            chunks.append((current.strip(), last_page, count, None))
            current = f"{tail(current, overlap)} {text}" if overlap else text
            count = tokens(current)
        else:
            current = f"{current} {text}" if current else text
            count += tokens(text)
        last_page = page
    return chunks + ([(current.strip(), last_page, count, None)] if current.strip() else [])


def random_text(rng):
    lines = []
    for _ in range(rng.randrange(1, 30)):
        pick = rng.random()
        if pick < 0.15:
            lines.append(rng.choice(["Abstract", " methods ", "Results and Discussion", "Summary", "1. Introduction", "References."]))
        elif pick < 0.3:
            lines.append(rng.choice(["a | b", "x   1.0   2.0 more", "|", "Yield\t\t\t2.5 kg ha"]))
        elif pick < 0.4:
            lines.append(rng.choice(["", "   ", "a. b. c. d."]))
        elif pick < 0.5:
            lines.append(f"[PAGE {rng.randrange(1, 9)}]")
        else:
            words = rng.choices(["seed", "é", "yield", "12.5", "in", "phosphorus", "Rhizobium"], k=rng.randrange(1, 40))
            lines.append(" ".join(w + rng.choice(["", "", ".", "!", "? "]) for w in words))
    return rng.choice(["", "lost words. ", ""]) + "[PAGE 1]\n" + "\n".join(lines)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [random_text(rng) for _ in range(300)] + ["", "no pages", "[PAGE 1]", "[PAGE 2]\n\n[PAGE 3]\nx"]


def run(spark, texts, fold, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", fold(F.col("text"), size, overlap).alias("c")).orderBy("i").collect()
    return [[(c["text"], c["page_number"], c["token_count"], c["section"]) for c in r["c"]] for r in rows]


@pytest.mark.parametrize("size,overlap", [(512, 128), (30, 8), (10, 10), (20, 0), (1, 3)])
def test_section_fold(spark, texts, size, overlap):
    assert run(spark, texts, fold_sections, size, overlap) == [expected_sections(t, size, overlap) for t in texts]


@pytest.mark.parametrize("size,overlap", [(512, 50), (30, 8), (20, 0)])
def test_plain_fold(spark, texts, size, overlap):
    assert run(spark, texts, fold_plain, size, overlap) == [expected_plain(t, size, overlap) for t in texts]


def test_oversized_sentence_stays_whole(spark):
    long = "word " * 1000
    assert run(spark, [f"[PAGE 1]\n{long}"], fold_sections, 512, 128) == [[(long.strip(), 1, 1249, "")]]


def test_long_document(spark):
    """A book-sized document: the cost of a step must not grow with the chunks behind it."""
    rng = random.Random(1)
    lines = [" ".join(rng.choices(["pod", "seed", "leaf."], k=12)) for _ in range(20000)]
    text = "[PAGE 1]\n" + "\n".join(lines)
    assert run(spark, [text], fold_sections, 64, 16) == [expected_sections(text, 64, 16)]
    assert run(spark, [text], fold_plain, 64, 16) == [expected_plain(text, 64, 16)]


def test_page_is_the_one_being_read_when_the_chunk_closes(spark):
    text = "[PAGE 1]\naaaa aaaa aaaa.\n[PAGE 2]\nbbbb bbbb bbbb."
    assert run(spark, [text], fold_sections, 4, 0) == [[("aaaa aaaa aaaa.", 2, 3, ""), ("bbbb bbbb bbbb.", 2, 3, "")]]


def test_chunk_documents(spark):
    rows = [("[PAGE 1]\nAbstract\nOne two. Three\n a|b", "f.pdf", "2001"), ("[PAGE 1]", "short.pdf", "x"), (None, "null.pdf", "x")]
    chunks = chunk_documents(spark.createDataFrame(rows, "text string, source_file string, year_range string"))
    got = [tuple(r) for r in chunks.orderBy("chunk_id").collect()]
    assert got == [
        ("One two. Three", "f.pdf", "2001", 0, 1, 3, "abstract"),
        ("a|b", "f.pdf", "2001", 1, 1, 0, "abstract"),
    ]


def test_fold_needs_no_shuffle(spark):
    df = spark.createDataFrame([("[PAGE 1]\nx", "f", "y")], "text string, source_file string, year_range string")
    plan = chunk_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def char_tokenizer():
    """Four characters per token, so that results must equal the built-in count."""
    from sparquill.operators.tokenized import Tokenizer

    class Quarters(Tokenizer):
        def count(self, text):
            return len(text) // 4

        def tail(self, text, n):
            return text[-4 * n:] if n else ""

    return Quarters(None, None)


def word_tokenizer():
    from sparquill.operators.tokenized import Tokenizer

    words = {}
    return Tokenizer(
        lambda text: [words.setdefault(w, len(words)) for w in text.split(" ")],
        lambda ids: " ".join(list(words)[i] for i in ids),
    )


@pytest.mark.parametrize("sections", [True, False])
@pytest.mark.parametrize("size,overlap", [(30, 8), (20, 0)])
def test_tokenizer_plan_agrees(spark, texts, size, overlap, sections):
    rows = [(i, t, f"f{i}", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "i int, text string, source_file string, year_range string").repartition(4)
    built_in = chunk_documents(docs, size, overlap, sections, keep=("i",))
    tokenized = chunk_documents(docs, size, overlap, sections, keep=("i",), tokenizer=char_tokenizer)
    assert tokenized.columns == built_in.columns
    assert sorted(map(str, tokenized.collect())) == sorted(map(str, built_in.collect()))


def test_words_as_tokens(spark):
    docs = spark.createDataFrame([("[PAGE 1]\na b c. d e f. g h. Methods", "f", "y")], "text string, source_file string, year_range string")
    got = chunk_documents(docs, 6, 2, tokenizer=word_tokenizer).collect()
    assert [(r["text"], r["token_count"], r["section"]) for r in got] == [("a b c. d e f.", 6, ""), ("e f. g h.", 4, "")]
