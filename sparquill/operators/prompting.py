"""Prompts, reference lists and answers, as expressions over the ``sources`` array."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T

# (prompt, messages, sources) -> struct<answer:string,error:string>
Generator = Callable[[Column, Column, Column], Column]


def _page(source: Column) -> Column:
    return F.coalesce(source["page"].cast("string"), F.lit("?"))


def _is_weak(source: Column) -> Column:
    return source["distance"] > vocab.DISTANCE_INFERRED


def build_context(sources: Column) -> Column:
    """Numbered evidence blocks with DOI, page, section tag and a weak-evidence mark."""

    def block(source: Column, i: Column) -> Column:
        tag = T.section_tag(source["section"])
        header = F.concat_ws(
            " | ",
            F.concat(F.lit("doi:"), source["doi"]),
            F.concat(F.lit("p."), _page(source)),
            F.when(tag != "", tag),
            F.when(_is_weak(source), vocab.WEAK_EVIDENCE),
        )
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), header, F.lit("\n"), source["text"], F.lit("\n"))

    return F.array_join(F.transform(sources, block), "\n")


def _has_gap(confidence: Column) -> Column:
    return confidence.isin("INFERRED", "UNSUPPORTED")


def build_messages(question: Column, sources: Column, confidence: Column) -> Column:
    """Chat messages: ``array<struct<role,content>>``."""
    note = F.when(_has_gap(confidence), "\n\n" + vocab.GAP_NOTE).otherwise("")
    user = F.concat(
        F.lit("RETRIEVED SOURCES:\n\n"), build_context(sources), F.lit("\n"), note, F.lit("\nQUESTION: "), question
    )
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(vocab.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def build_prompt(question: Column, sources: Column, confidence: Column) -> Column:
    """One prompt string with instruct-model headers."""
    note = F.when(_has_gap(confidence), "\n" + vocab.GAP_NOTE + "\n").otherwise("")
    return F.concat(
        F.lit("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n" + vocab.SYSTEM_PROMPT + "<|eot_id|>"),
        F.lit("<|start_header_id|>user<|end_header_id|>\nRETRIEVED SOURCES:\n\n"),
        build_context(sources),
        F.lit("\n"),
        note,
        F.lit("QUESTION: "),
        question,
        F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"),
    )


def format_references(sources: Column) -> Column:
    """Reference list, one line per DOI in rank order; weak ones are marked, not left out."""

    def listed(dois: Column) -> Column:
        first = F.filter(
            sources, lambda s, i: (s["doi"] != "") & (F.array_position(dois, s["doi"]) == (i + 1).cast("long"))
        )
        entries = F.transform(
            first,
            lambda s: F.concat(F.lit("• doi:"), s["doi"], F.when(_is_weak(s), vocab.WEAK_REFERENCE).otherwise("")),
        )
        return F.when(
            F.size(entries) > 0, F.concat(F.lit(vocab.REFERENCE_HEADING + "\n"), F.array_join(entries, "\n"))
        ).otherwise("")

    return T.let(F.transform(sources, lambda s: F.coalesce(s["doi"], F.lit(""))), listed)


# -- generators ---------------------------------------------------------------


def extractive_generator(prompt: Column, messages: Column, sources: Column) -> Column:
    """No model: the first sentence of the first source, with its citation."""
    top = F.get(sources, 0)
    said = F.coalesce(F.get(T.sentences(top["text"]), 0), F.lit(""))
    answer = F.concat(said, F.lit(" (doi:"), top["doi"], F.lit(", p."), _page(top), F.lit(")"))
    # no prompt means the question is not to be answered
    return F.struct(F.when(prompt.isNotNull(), answer).alias("answer"), F.lit(None).cast("string").alias("error"))


def _post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(
        url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers}
    )
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


def _calling(ask: Callable[[str], str]):
    """A UDF that calls a service per non-NULL input and keeps failures in ``error``."""

    @F.arrow_udf("struct<answer:string,error:string>")
    def run(inputs: pa.Array) -> pa.Array:
        answers: list[str | None] = []
        errors: list[str | None] = []
        for text in inputs.to_pylist():
            answer = error = None
            if text is not None:
                try:
                    answer = ask(text)
                except Exception as failure:
                    error = str(failure)
            answers.append(answer)
            errors.append(error)
        return pa.StructArray.from_arrays(
            [pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["answer", "error"]
        )

    return run.asNondeterministic()


def prompt_service_generator(
    url: str, model: str, temperature: float = 0.1, max_tokens: int = 1024, timeout: float = 180.0
) -> Generator:
    """A local completion service that takes a prompt string."""

    def ask(prompt: str) -> str:
        payload = {
            "model": model,
            "prompt": prompt,
            "stream": False,
            "options": {"temperature": temperature, "num_predict": max_tokens},
        }
        return _post(url, payload, {}, timeout)["response"].strip()

    run = _calling(ask)
    return lambda prompt, messages, sources: run(prompt)


def chat_service_generator(
    url: str, model: str, token: str, temperature: float = 0.1, max_tokens: int = 1024, timeout: float = 180.0
) -> Generator:
    """A hosted chat-completion service that takes messages."""

    def ask(messages: str) -> str:
        payload = {
            "model": model,
            "messages": json.loads(messages),
            "temperature": temperature,
            "max_tokens": max_tokens,
        }
        reply = _post(url, payload, {"Authorization": f"Bearer {token}"}, timeout)
        return reply["choices"][0]["message"]["content"].strip()

    run = _calling(ask)
    return lambda prompt, messages, sources: run(F.when(prompt.isNotNull(), F.to_json(messages)))


def service_is_up(url: str, timeout: float = 5.0) -> bool:
    """Driver-side probe of a generation service."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as response:
            return response.status == 200
    except Exception:
        return False
