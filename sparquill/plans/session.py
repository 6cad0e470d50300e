"""An interactive session without a user interface: commands change its settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from sparquill import vocab
from sparquill.operators import prompting as P
from sparquill.plans import answering as A


@dataclass
class Session:
    """Feed it lines.  A command returns a message, a question returns answer rows."""

    collection: DataFrame
    generator: P.Generator = P.extractive_generator
    year_filter: str | None = None
    top_k: int = vocab.TOP_K
    finished: bool = False
    options: dict[str, Any] = field(default_factory=dict)

    def feed(self, line: str) -> str | DataFrame | None:
        line = line.strip()
        if not line:
            return None
        if line == "/quit":
            self.finished = True
            return "Bye!"
        if line == "/help":
            return vocab.SESSION_HELP
        command, _, argument = line.partition(" ")
        if command == "/year" and argument:
            return self._set_year(argument.strip())
        if command == "/sources" and argument:
            return self._set_sources(argument)
        return self.ask(line)

    def _set_year(self, value: str) -> str:
        if value == "off":
            self.year_filter = None
            return "Year filter removed."
        if value in vocab.YEAR_CHOICES:
            self.year_filter = value
            return f"Year filter: {value}"
        return "Valid options: /year 1961-2006 | /year 2007-2026 | /year off"

    def _set_sources(self, value: str) -> str:
        try:
            self.top_k = int(value)
        except ValueError:
            return "Usage: /sources <number>"
        return f"Sources set to: {self.top_k}"

    def ask(self, question: str) -> DataFrame:
        questions = self.collection.sparkSession.createDataFrame([(0, question)], "query_id int, question string")
        where = {"year_range": self.year_filter} if self.year_filter else None
        retrieved = A.retrieve(questions, self.collection, self.top_k, where=where, routed=True, **self.options)
        return A.answer(retrieved, self.generator, year_filter=self.year_filter, top_k=self.top_k)
