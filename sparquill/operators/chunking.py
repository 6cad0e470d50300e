"""The chunk fold: marked text to overlapping, section- and table-aware chunks.

One row holds one document, so the fold is an expression over that row: no shuffle, no
grouping, and no document can make another one wait.  State only flows between the
sentences of one document, through ``F.aggregate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.schemas import CHUNK_COLUMNS

_CHUNK = "struct<text:string,page_number:int,token_count:int,section:string>"
TABLE, SENTENCE = 1, 2


def _step(kind: int, content: Column, page: Column, section: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        content.alias("text"),
        T.count_tokens(content).alias("tokens"),
        page.alias("page"),
        section.alias("section"),
    )


def _sentence_steps(content: Column, page: Column, headers: bool) -> Column:
    no_section = F.lit(None).cast("string")
    return F.transform(
        T.sentences(content),
        lambda s: _step(SENTENCE, s, page, T.detect_section(s) if headers else no_section),
    )


def _block_steps(block: Column, page: Column) -> Column:
    def by_type(content: Column) -> Column:
        table = F.array(_step(TABLE, content, page, F.lit(None).cast("string")))
        return F.when(content == "", F.slice(table, 1, 0)).when(
            block["type"] == "table", table
        ).otherwise(_sentence_steps(content, page, headers=True))

    return T.let(T.strip(block["content"]), by_type)


def section_steps(marked: Column) -> Column:
    """Everything the fold has to look at, in reading order."""
    return F.flatten(
        F.transform(
            T.pages(marked),
            lambda p: F.flatten(
                F.transform(T.table_blocks(T.lines(p["body"])), lambda b: _block_steps(b, p["number"]))
            ),
        )
    )


def plain_steps(marked: Column) -> Column:
    """Sentences only, split across line ends."""
    return F.flatten(
        F.transform(T.pages(marked), lambda p: _sentence_steps(p["body"], p["number"], headers=False))
    )


def _chunk(content: Column, page: Column, tokens: Column, section: Column) -> Column:
    return F.struct(
        content.alias("text"), page.alias("page_number"), tokens.alias("token_count"), section.alias("section")
    ).cast(_CHUNK)


def _start() -> Column:
    return F.struct(
        F.lit("").alias("text"),
        F.lit(0).alias("tokens"),
        F.lit("").alias("section"),
        F.lit(1).alias("page"),
        F.array().cast(f"array<{_CHUNK}>").alias("done"),
    )


def _run(steps: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """``F.aggregate`` over the steps, in runs of about the square root of their number.

    ``aggregate`` copies its whole state after every element, finished chunks included.
    Within a run the state only holds the run's own chunks; the long list is copied once
    per run.  A document of any length then costs little more than its length.
    """

    def over(items: Column) -> Column:
        n = F.size(items)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(16))

        def in_runs(w: Column) -> Column:
            runs = F.transform(
                F.sequence(F.lit(0), F.floor((n - 1) / w).cast("int")), lambda r: F.slice(items, r * w + 1, w)
            )
            return F.aggregate(runs, _start(), one_run, finish)

        return F.when(n > 0, T.let(width, in_runs)).otherwise(F.array().cast(f"array<{_CHUNK}>"))

    def one_run(acc: Column, run: Column) -> Column:
        fields = ("text", "tokens", "section", "page")
        fresh = F.struct(*[acc[f].alias(f) for f in fields], F.array().cast(f"array<{_CHUNK}>").alias("done"))
        return F.aggregate(
            run,
            fresh,
            merge,
            lambda end: F.struct(*[end[f].alias(f) for f in fields], F.concat(acc["done"], end["done"]).alias("done")),
        )

    return T.let(steps, over)


def fold_sections(marked: Column, chunk_size: int = vocab.CHUNK_SIZE, overlap: int = vocab.CHUNK_OVERLAP) -> Column:
    """Chunks of a marked text, as ``array<struct<text,page_number,token_count,section>>``.

    A table is a chunk of its own and a header starts a section; both end the running
    chunk without overlap.  A sentence that would overfill the running chunk closes it,
    and the next one starts with the tail of the closed text.  The page of a chunk is
    the page being read when the chunk is closed.
    """

    def merge(acc: Column, step: Column) -> Column:
        is_table = step["kind"] == TABLE
        is_header = step["section"].isNotNull()
        full = (acc["text"] != "") & (acc["tokens"] + step["tokens"] > chunk_size)
        closes = (acc["text"] != "") & (is_table | is_header | full)

        carried = T.strip(F.concat(T.overlap_tail(acc["text"], overlap), F.lit(" "), step["text"]))
        joined = F.when(acc["text"] == "", step["text"]).otherwise(
            F.concat(acc["text"], F.lit(" "), step["text"])
        )
        running = F.when(is_table | is_header, F.lit("")).when(full, carried).otherwise(joined)
        closed = _chunk(acc["text"], step["page"], acc["tokens"], acc["section"])
        table = _chunk(step["text"], step["page"], step["tokens"], acc["section"])
        done = (
            F.when(is_table & closes, F.concat(acc["done"], F.array(closed, table)))
            .when(is_table, F.concat(acc["done"], F.array(table)))
            .when(closes, F.concat(acc["done"], F.array(closed)))
            .otherwise(acc["done"])
        )
        tokens = (
            F.when(is_table | is_header, F.lit(0))
            .when(full, T.count_tokens(carried))
            .otherwise(acc["tokens"] + step["tokens"])
        )
        return F.struct(
            running.alias("text"),
            tokens.alias("tokens"),
            F.coalesce(step["section"], acc["section"]).alias("section"),
            step["page"].alias("page"),
            done.alias("done"),
        )

    def finish(acc: Column) -> Column:
        last = _chunk(acc["text"], acc["page"], acc["tokens"], acc["section"])
        return F.when(acc["text"] != "", F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return _run(section_steps(marked), merge, finish)


def fold_plain(marked: Column, chunk_size: int = vocab.CHUNK_SIZE, overlap: int = vocab.V1_CHUNK_OVERLAP) -> Column:
    """The first-version fold: sentences only, split across line ends, no sections.

    A chunk is filed under the page of its last sentence, and the carried tail keeps
    its leading space until the chunk is written.
    """
    def merge(acc: Column, step: Column) -> Column:
        full = (acc["text"] != "") & (acc["tokens"] + step["tokens"] > chunk_size)
        tail = T.overlap_tail(acc["text"], overlap) if overlap > 0 else F.lit("")
        carried = F.concat(tail, F.lit(" "), step["text"]) if overlap > 0 else step["text"]
        joined = F.when(acc["text"] == "", step["text"]).otherwise(
            F.concat(acc["text"], F.lit(" "), step["text"])
        )
        closed = _chunk(T.strip(acc["text"]), acc["page"], acc["tokens"], F.lit(None))
        return F.struct(
            F.when(full, carried).otherwise(joined).alias("text"),
            F.when(full, T.count_tokens(carried)).otherwise(acc["tokens"] + step["tokens"]).alias("tokens"),
            acc["section"].alias("section"),
            step["page"].alias("page"),
            F.when(full, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        last = _chunk(T.strip(acc["text"]), acc["page"], acc["tokens"], F.lit(None))
        return F.when(T.strip(acc["text"]) != "", F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return _run(plain_steps(marked), merge, finish)


def chunk_documents(
    documents: DataFrame,
    chunk_size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
    sections: bool = True,
    keep: tuple[str, ...] = (),
    tokenizer: Callable | None = None,
) -> DataFrame:
    """``(text, source_file, year_range)`` rows to chunk rows, ids dense per document.

    ``text`` is marked text.  Columns named in ``keep`` are carried along.  Tokens are
    four characters unless a ``tokenizer`` (see ``operators.tokenized``) is given.
    """
    documents = documents.where(F.length(T.strip(F.col("text"))) >= vocab.MIN_DOCUMENT_CHARS)
    if tokenizer is not None:
        from sparquill.operators.tokenized import chunk_with_tokenizer

        return chunk_with_tokenizer(documents, tokenizer, chunk_size, overlap, sections, keep)
    fold = fold_sections if sections else fold_plain
    exploded = documents.select(
        *keep,
        "source_file",
        "year_range",
        F.posexplode(fold(F.col("text"), chunk_size, overlap)).alias("chunk_id", "chunk"),
    )
    return exploded.select(
        *keep,
        *[F.col(f"chunk.{c}") if c in ("text", "page_number", "token_count", "section") else F.col(c)
          for c in CHUNK_COLUMNS],
    )
