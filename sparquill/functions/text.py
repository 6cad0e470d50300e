"""Text and regex functions as ``Column -> Column`` expressions (JVM side, no UDFs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparquill import vocab

# The characters Python treats as whitespace in str.strip() and in ``\s``.  Java's
# ``\s`` is narrower, so both forms are spelled out once and used everywhere.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# For patterns that begin with (?U), which makes ``\s`` cover all of Unicode.
WS = r"[\s\x1c-\x1f]"
SENTENCE_BREAK = rf"(?U)(?<=[.!?]){WS}+"
PAGE_MARKER = r"\[PAGE ([0-9]+)\]"
# One word is a maximal run of letters, digits and underscores in any script.
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Lambda bodies are evaluated per element, so an expensive operand named inside one
    would be recomputed for every element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def first_match(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """Ordered CASE WHEN: the first true condition wins."""
    result = F
    for condition, value in cases:
        result = result.when(condition, value)
    return result.otherwise(default) if cases else default


# -- lines, sentences, pages --------------------------------------------------

_SECTION_WORD = [
    # (?d): only \n ends a line, as in Python
    (name, r"(?iumdU)\A" + WS + "*" + pattern.replace(r"\s", WS) + WS + "*$")
    for name, pattern in vocab.SECTION_PATTERNS
]
_ANY_SECTION = (
    r"(?iumdU)\A" + WS + "*(?:"
    + "|".join(pattern.replace(r"\s", WS) for _, pattern in vocab.SECTION_PATTERNS)
    + ")" + WS + "*$"
)


def detect_section(line: Column) -> Column:
    """Section named by a header line, else NULL.  The first pattern that fits wins."""

    def classify(text: Column) -> Column:
        named = first_match(
            [(text.rlike(p), F.lit(name)) for name, p in _SECTION_WORD],
            F.lit(None).cast("string"),
        )
        # almost no line is a header: one combined test settles those
        return F.when(text.rlike(_ANY_SECTION), named)

    return let(strip(line), classify)


def is_table_row(line: Column) -> Column:
    """A pipe anywhere, or three or more spaces between tokens on a line over 10 chars."""
    # a run of spaces inside the stripped line has a token on either side
    spaced = let(strip(line), lambda text: (F.length(text) > 10) & text.rlike(rf"(?U){WS}{{3}}"))
    return F.contains(line, F.lit("|")) | spaced


def table_blocks(lines: Column) -> Column:
    """Group each maximal run of table rows into one block; other lines stand alone.

    ``array<string>`` in, ``array<struct<type,content>>`` out.
    """

    def group(rows: Column) -> Column:
        def with_flags(flags: Column) -> Column:
            starts = F.filter(
                F.sequence(F.lit(0), F.size(rows) - 1),
                lambda i: ~(F.get(flags, i) & (i > 0) & F.coalesce(F.get(flags, i - 1), F.lit(False))),
            )

            def cut(begin: Column) -> Column:
                return F.transform(
                    begin,
                    lambda s, j: F.struct(
                        F.when(F.get(flags, s), "table").otherwise("text").alias("type"),
                        F.array_join(
                            F.slice(rows, s + 1, F.coalesce(F.get(begin, j + 1), F.size(rows)) - s),
                            "\n",
                        ).alias("content"),
                    ),
                )

            return let(starts, cut)

        return let(F.transform(rows, lambda line: is_table_row(line)), with_flags)

    kind = "array<struct<type:string,content:string>>"
    # most pages hold no table at all: one look at the whole page settles those
    suspicious = F.exists(lines, lambda line: F.contains(line, F.lit("|")) | line.rlike(rf"(?U){WS}{{3}}"))
    text_only = F.transform(lines, lambda line: F.struct(F.lit("text").alias("type"), line.alias("content"))).cast(kind)
    return F.when(suspicious, let(lines, group).cast(kind)).otherwise(text_only)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?``; pieces are stripped and empty ones dropped."""
    pieces = F.transform(F.split(text, SENTENCE_BREAK, -1), lambda s: strip(s))
    return F.filter(pieces, lambda s: s != "")


def pages(marked: Column) -> Column:
    """``[PAGE n]`` marked text as ``array<struct<number,body>>``.

    Text before the first marker is dropped.
    """

    def zipped(bodies: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(marked, F.lit(PAGE_MARKER), F.lit(1)),
            lambda n, i: F.struct(n.try_cast("int").alias("number"), F.get(bodies, i + 1).alias("body")),
        )

    return let(F.split(marked, PAGE_MARKER, -1), zipped)


def mark_pages(page_texts: Column) -> Column:
    """``array<struct<number,body>>`` to marked text; pages without text are skipped."""
    kept = F.filter(page_texts, lambda p: p.body.isNotNull() & (p.body != ""))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(F.lit("[PAGE "), p.number.cast("string"), F.lit("]\n"), p.body)),
        "\n\n",
    )


def needs_ocr(page_text: Column) -> Column:
    return F.length(strip(F.coalesce(page_text, F.lit("")))) < vocab.OCR_MIN_CHARS


# -- tokens -------------------------------------------------------------------


def count_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.shiftright(F.length(text), 2)


def overlap_tail(text: Column, tokens: int) -> Column:
    """The last ``tokens`` tokens (four characters each); zero means no overlap."""
    return F.right(text, F.lit(vocab.CHARS_PER_TOKEN * tokens))


# -- file names ---------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extract_year_range(path: Column, strict: bool = False) -> Column:
    """First ``dddd-dddd`` in the path, else first 19xx/20xx in the file stem.

    ``strict`` accepts only ranges of plausible years, so that an ISSN is no range.
    """
    year = r"(?:19|20)[0-9]{2}"
    ranged = rf"(?<![0-9])({year}-{year})(?![0-9])" if strict else r"([0-9]{4}-[0-9]{4})"
    stem = F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")
    return F.coalesce(
        F.nullif(F.regexp_extract(path, ranged, 1), F.lit("")),
        F.nullif(F.regexp_extract(stem, rf"({year})", 1), F.lit("")),
        F.lit("unknown"),
    )


def filename_to_doi(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit(".pdf"), F.lit("")), r"\A(10\.[^_]*)_", "$1/")


def is_pdf_path(path: Column, case_sensitive: bool = False) -> Column:
    return (path if case_sensitive else F.lower(path)).endswith(".pdf")


# -- labels, routing, scoring -------------------------------------------------


def section_tag(section: Column) -> Column:
    lowered = F.lower(F.coalesce(section, F.lit("")))
    return first_match([(F.contains(lowered, F.lit(k)), F.lit(t)) for k, t in vocab.SECTION_TAGS], F.lit(""))


def preview(text: Column, chars: int = 100) -> Column:
    return F.substring(text, 1, chars)


def is_greeting(question: Column) -> Column:
    bare = F.rtrim(F.lower(strip(question)), F.lit(vocab.GREETING_TRAILERS))
    return bare.isin(vocab.GREETINGS)


def model_error_message(error: Column) -> Column:
    cases = [
        (F.contains(error, F.lit(code)) | F.contains(F.lower(error), F.lit(phrase)), F.lit(message))
        for code, phrase, message in vocab.MODEL_ERRORS
    ]
    return first_match(cases, F.concat(F.lit(vocab.MODEL_ERROR_OTHER), error))


def words(text: Column) -> Column:
    """Words of letters and digits of every script, lowercased: the vocabulary of the default encoder and pair scorer."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(found, lambda w: F.lower(w))


def rubric_keywords(item: Column) -> Column:
    """Distinct words of three or more characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(item), F.lit(f"({WORD}{{3,}})"), F.lit(1))
    return F.array_except(found, F.array(*[F.lit(w) for w in vocab.RUBRIC_STOP_WORDS]))


def has_doi_citation(answer: Column) -> Column:
    return F.lower(answer).rlike("(?U)" + vocab.DOI_CITATION_PATTERN.replace(r"\s", WS))


def has_confidence_label(answer: Column) -> Column:
    return F.lower(answer).rlike(vocab.LABEL_PATTERN)


def rubric_word_lists(rubric: Column) -> Column:
    """The keywords of each rubric item; worth computing once where a rubric is used often."""
    return F.transform(rubric, lambda item: rubric_keywords(item))


def covered_share(answer: Column, word_lists: Column) -> Column:
    """Share of keyword lists with any word inside the answer; 0.0 for no lists."""

    def hits(lowered: Column) -> Column:
        return F.size(F.filter(word_lists, lambda words: F.exists(words, lambda w: F.contains(lowered, w))))

    share = let(F.lower(answer), hits) / F.nullif(F.size(word_lists), F.lit(0))
    return F.coalesce(round_half_even(share, 2), F.lit(0.0))


def rubric_coverage(answer: Column, rubric: Column) -> Column:
    """Share of rubric items with any keyword inside the answer."""
    return covered_share(answer, rubric_word_lists(rubric))


# -- rounding -----------------------------------------------------------------


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double by its exact binary value, ties to even.

    ``value * 10**digits`` may round onto a tie that the exact product misses.  The
    product's rounding error is recovered by splitting ``value`` into halves that
    multiply exactly, and decides such ties.
    """
    scale = 10.0**digits

    def scaled(x: Column) -> Column:
        product = x * scale
        head = x * 134217729.0 - (x * 134217729.0 - x)
        error = (head * scale - product) + (x - head) * scale
        floor = F.floor(product).cast("double")
        tie = (product - floor) == 0.5
        nearest = F.when(tie & (error > 0), floor + 1).when(tie & (error < 0), floor).otherwise(F.rint(product))
        return nearest / scale + 0.0

    return let(value.cast("double"), scaled)
