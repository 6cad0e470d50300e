"""The chunk fold with a real tokenizer instead of four characters per token.

Spark does everything up to the list of steps (pages, tables, sentences, headers); only
counting tokens and cutting tails needs the tokenizer, so only the merge runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators.chunking import TABLE, plain_steps, section_steps
from sparquill.schemas import CHUNK, CHUNK_COLUMNS


@dataclass
class Tokenizer:
    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def tail(self, text: str, n: int) -> str:
        if n <= 0:
            return ""
        tokens = self.encode(text)
        return self.decode(tokens[-n:]) if len(tokens) > n else text


def tiktoken_tokenizer(name: str = "cl100k_base") -> Callable[[], Tokenizer]:
    """A byte-pair tokenizer; its vocabulary file has to be present on the workers."""

    def load() -> Tokenizer:
        import tiktoken  # optional

        encoding = tiktoken.get_encoding(name)
        return Tokenizer(lambda text: encoding.encode(text), encoding.decode)

    return load


def _merge(steps: list[dict], tokenizer: Tokenizer, size: int, overlap: int, sections: bool) -> Iterator[tuple]:
    """``(text, page, tokens, section)`` of every chunk of one document."""
    text, count, section, page = "", 0, "" if sections else None, 1
    for step in steps:
        here = step["page"] if sections else page
        n = tokenizer.count(step["text"])
        alone = step["kind"] == TABLE or step["section"] is not None
        full = bool(text) and count + n > size
        if text.strip() and (alone or full):
            yield text.strip(), here, count, section
        if step["kind"] == TABLE:
            yield step["text"], here, n, section
        if alone:
            text, count, section = "", 0, step["section"] or section
        elif full:
            carried = tokenizer.tail(text, overlap)
            text = f"{carried} {step['text']}" if sections or overlap > 0 else step["text"]
            text = text.strip() if sections else text
            count = tokenizer.count(text)
        else:
            text, count = f"{text} {step['text']}" if text else step["text"], count + n
        page = step["page"]
    if text.strip():
        yield text.strip(), page, count, section


def chunk_with_tokenizer(
    documents: DataFrame, tokenizer: Callable[[], Tokenizer], size: int, overlap: int, sections: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Like ``chunk_documents``, which calls this when it is given a tokenizer."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    steps = section_steps if sections else plain_steps
    carried = [*keep, "source_file", "year_range"]
    rows = documents.select(*carried, steps(F.col("text")).alias("steps"))
    schema = StructType([documents.schema[c] for c in keep] + [f for f in CHUNK.fields])
    arrow_schema = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = tokenizer()
        for batch in batches:
            for document in batch.to_pylist():
                out = []
                for i, (text, page, count, section) in enumerate(_merge(document["steps"] or [], loaded, size, overlap, sections)):
                    chunk = dict(zip(CHUNK_COLUMNS, (text, document["source_file"], document["year_range"], i, page, count, section)))
                    out.append({**{c: document[c] for c in keep}, **chunk})
                if out:
                    yield pa.RecordBatch.from_pylist(out, arrow_schema)

    return rows.mapInArrow(fold, schema)
