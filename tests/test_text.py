import math
import random

import pytest
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T


def test_section_headers(values):
    cases = {
        "Abstract": "abstract",
        "  INTRODUCTION  ": "introduction",
        "background": "introduction",
        "Materials and Methods": "methods",
        "material  and\tmethod": "methods",
        "Methodology": "methods",
        "experimental": "methods",
        "Results": "results",
        "Result": "results",
        "Results and Discussion": "results",
        "Discussion": "discussion",
        "Conclusions": "conclusion",
        "summary": "conclusion",
        "Bibliography": "references",
        "Literature   Cited": "references",
        " Abstract ": "abstract",
        "Abstract\nof something": "abstract",
        "Abstract.": None,
        "Abstract:": None,
        "1. Introduction": None,
        "The Results": None,
        "discussions": None,
        "": None,
    }
    assert values(T.detect_section, *cases) == list(cases.values())


def test_table_rows(values):
    cases = {
        "a|b": True,
        "|": True,
        "Height   1.25 m": True,
        "a   b": False,  # ten characters or fewer
        "   indented text only": False,
        "trailing spaces here     ": False,
        "two  spaces  between  words": False,
        "tab\t\t\tseparated": True,
        "Trait \t 1.0 and more": True,
        "": False,
    }
    assert values(T.is_table_row, *cases) == list(cases.values())


def test_table_blocks(values):
    blocks = values(lambda c: T.table_blocks(T.lines(c)), "a|b\nc|d\nplain\n\ne|f\n\ng|h", "", "x|y")
    assert [(b["type"], b["content"]) for b in blocks[0]] == [
        ("table", "a|b\nc|d"), ("text", "plain"), ("text", ""), ("table", "e|f"), ("text", ""), ("table", "g|h"),
    ]
    assert [(b["type"], b["content"]) for b in blocks[1]] == [("text", "")]
    assert [(b["type"], b["content"]) for b in blocks[2]] == [("table", "x|y")]


def test_sentences(values):
    got = values(T.sentences, "One. Two!  Three?\nFour.Five", "1. Introduction", " . . ", "148.9 kg. 0.5", "")
    assert got == [["One.", "Two!", "Three?", "Four.Five"], ["1.", "Introduction"], [".", "."], ["148.9 kg.", "0.5"], []]


def test_pages(values):
    got = values(T.pages, "lost [PAGE 1]\na\n\n[PAGE 12]\nb [PAGE x]", "no marker", "[PAGE 3]")
    assert [[(p["number"], p["body"]) for p in g] for g in got] == [[(1, "\na\n\n"), (12, "\nb [PAGE x]")], [], [(3, "")]]


def test_mark_pages_skips_empty(spark):
    df = spark.createDataFrame([([(1, "a"), (2, ""), (3, None), (4, "b")],)], "p array<struct<number:int,body:string>>")
    assert df.select(T.mark_pages(F.col("p"))).first()[0] == "[PAGE 1]\na\n\n[PAGE 4]\nb"


def test_tokens_and_overlap(values):
    assert values(T.count_tokens, "", "abc", "abcd", "é" * 9, "😀" * 8) == [0, 0, 1, 2, 2]
    assert values(lambda c: T.overlap_tail(c, 2), "0123456789", "abc") == ["23456789", "abc"]
    assert values(lambda c: T.overlap_tail(c, 0), "0123456789") == [""]


def test_year_range(values):
    cases = {
        "/d/1961-2006/10.1/x.pdf": "1961-2006",
        "/a/0011-1832/1961-2006/x.pdf": "0011-1832",
        "/d/10.1002_plr2.20289.pdf": "2028",
        "/d/1999/paper.pdf": "unknown",
        "/d/paper1999.pdf": "1999",
        "/d/paper.2010": "unknown",
        "/d/a.2015.pdf": "2015",
        "/d/x.pdf": "unknown",
    }
    assert values(T.extract_year_range, *cases) == list(cases.values())
    strict = values(lambda c: T.extract_year_range(c, strict=True), "/a/0011-1832/1961-2006/x.pdf", "/a/0011-1832/x.pdf")
    assert strict == ["1961-2006", "unknown"]


def test_doi(values):
    cases = {
        "10.2135_cropsci2004.1799.pdf": "10.2135/cropsci2004.1799",
        "10.1_a_b.pdf": "10.1/a_b",
        "report_1999.pdf": "report_1999",
        "a.pdf.pdf": "a",
        "10.5.pdf": "10.5",
    }
    assert values(T.filename_to_doi, *cases) == list(cases.values())


def test_section_tags(values):
    cases = {"methods": "[METHODS]", "Abstract table": "[ABSTRACT]", "my Figure": "[FIGURE]", "": "", None: "", "other": ""}
    assert values(T.section_tag, *cases) == list(cases.values())


def test_greetings(values):
    assert values(T.is_greeting, " Hello!! ", "WHAT'S UP?", "good morning. ", "hello bean", "", "hi?.! ") == [
        True, True, True, False, False, True,
    ]


def test_model_errors(values):
    got = values(T.model_error_message, "code 401", "Unauthorized", "429", "Rate Limit", "Unavailable now", "boom")
    texts = [m for _, _, m in vocab.MODEL_ERRORS]
    assert got == [texts[0], texts[0], texts[1], texts[1], texts[2], "LLM error: boom"]


def test_rubric(values, spark):
    assert values(T.rubric_keywords, "The pH range (typically 6.0–7.0), été and été") == [["range", "typically", "été"]]
    df = spark.createDataFrame(
        [
            ("Nodules fix N", ["mention of Rhizobium", "nodulation or nodules"]),
            ("nothing", []),
            ("a", ["the of", "an"]),
            ("x range z", ["range", "b1c", "qqq", "www", "eee", "rrr", "ttt", "yyy"]),
        ],
        "a string, r array<string>",
    )
    assert [r[0] for r in df.select(T.rubric_coverage(F.col("a"), F.col("r"))).collect()] == [0.5, 0.0, 0.0, 0.12]


def test_citation_and_label(values):
    assert values(T.has_doi_citation, "see DOI: 10.1234/x", "doi:10.123", "doi 10.1234") == [True, False, False]
    assert values(T.has_confidence_label, "[Supported]", "[PARTIALLY_SUPPORTED]", "[none]", "supported") == [True, True, False, False]


def test_needs_ocr(values):
    assert values(T.needs_ocr, None, " " * 80, "x" * 49, "x" * 50) == [True, True, True, False]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_rounding_is_exact(values, digits):
    rng = random.Random(digits)
    numbers = [0.125, 0.375, 0.355, 2.675, 1.005, -2.5, -0.125, 1e10 + 0.5, 0.30625, 0.0]
    numbers += [rng.randrange(10**6) / 10 ** rng.randrange(1, 7) for _ in range(500)]
    numbers += [rng.randrange(200) / 16 for _ in range(100)]
    got = values(lambda c: T.round_half_even(c, digits), *numbers, type="double")
    assert all(math.isclose(g, round(n, digits), abs_tol=0, rel_tol=0) for g, n in zip(got, numbers))
