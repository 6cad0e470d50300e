import pytest
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.operators import prompting as P
from sparquill.operators import retrieval as R
from sparquill.plans import answering as A


def test_expand_queries(spark):
    cases = {
        "Do we trust it": "Do we trust it bean rust Uromyces appendiculatus",
        "indeterminate": "indeterminate climbing bean vining bush bean upright",
        "Tepary Bean": "Tepary Bean common bean dry bean Phaseolus acutifolius",  # the one-word alias is a query word
        "tepary bean dry": "tepary bean dry common bean dry bean Phaseolus acutifolius tepary",
        "nothing here": "nothing here",
        "": "",
        "resistance tolerance": "resistance tolerance immunity",
        "rust bcmv drought bean yield": "rust bcmv drought bean yield bean rust Uromyces appendiculatus "
        "bean common mosaic virus bean common mosaic necrosis virus water deficit water stress",
    }
    cases["Tepary Bean"] = "Tepary Bean common bean dry bean Phaseolus acutifolius"
    cases["tepary bean dry"] = "tepary bean dry common bean dry bean Phaseolus acutifolius"
    got = R.expand_queries(spark.createDataFrame([(q,) for q in cases], "question string")).collect()
    assert {r["question"]: r["expanded"] for r in got} == cases
    own = R.expand_queries(spark.createDataFrame([("it's 5\\6",)], "question string"), synonyms=[("it's", ["a'b", "c\\d", "e"])])
    assert own.first()["expanded"] == "it's 5\\6 a'b c\\d"


def candidate_rows(spark, rows):
    schema = "query_id int, source string, page int, distance double, rank int"
    return spark.createDataFrame(rows, schema)


def test_deduplicate_keeps_the_nearest_whatever_the_order(spark):
    rows = [(1, "a", 1, 0.5, 3), (1, "a", 1, 0.2, 1), (1, "a", 1, 0.2, 2), (1, "b", 1, 0.9, 9), (2, "a", 1, 0.7, 1), (1, "c", None, 0.3, 4), (1, "c", None, 0.1, 0)]
    got = sorted((tuple(r) for r in R.deduplicate(candidate_rows(spark, rows)).collect()), key=str)
    assert got == [(1, "a", 1, 0.2, 1), (1, "b", 1, 0.9, 9), (1, "c", None, 0.1, 0), (2, "a", 1, 0.7, 1)]


def test_hot_group_is_merged_before_the_shuffle(spark):
    rows = spark.range(0, 200000, 1, 8).select(
        F.lit(1).alias("query_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"),
        F.lit(1).alias("page"), (F.col("id") % 997 / 1000).alias("distance"), F.col("id").alias("rank"),
    )
    got = R.deduplicate(rows)
    assert got.count() == 200000 - 66667 + 1
    assert tuple(got.where("source = 'hot'").select("distance", "rank").first()) == (0.0, 0)
    assert "partial_min_by" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "distances,label",
    [
        ([0.45, 0.85, 0.85], "SUPPORTED"),
        ([0.45, 0.85], "PARTIALLY_SUPPORTED"),
        ([0.45, 0.86, 0.86], "INFERRED"),
        ([0.65, 0.85, 0.1], "PARTIALLY_SUPPORTED"),
        ([0.65, 0.9], "INFERRED"),
        ([0.85], "INFERRED"),
        ([0.9, 0.1, 0.1, 0.1], "UNSUPPORTED"),  # the first after reranking counts, not the nearest
        ([], "UNSUPPORTED"),
    ],
)
def test_confidence(spark, distances, label):
    df = spark.createDataFrame([([(d,) for d in distances],)], "s array<struct<distance:double>>")
    assert df.select(R.confidence_label(F.col("s"))).first()[0] == label


def sources(spark, rows):
    schema = R.SOURCE
    return spark.createDataFrame([(rows,)], f"s array<{schema}>")


def source(rank, doi, distance, section="", page=1, text="Some text. More."):
    return (rank, text, "f.pdf", doi, "2001", page, section, distance, None)


def test_context_and_references(spark):
    df = sources(spark, [source(1, "10.1/a", 0.85, "methods"), source(2, "10.1/b", 0.8501, "", None), source(3, "10.1/a", 0.9), source(4, "", 0.1)])
    context, refs = df.select(P.build_context(F.col("s")), P.format_references(F.col("s"))).first()
    assert context == (
        "[1] doi:10.1/a | p.1 | [METHODS]\nSome text. More.\n\n"
        "[2] doi:10.1/b | p.? | ⚠ WEAK EVIDENCE\nSome text. More.\n\n"
        "[3] doi:10.1/a | p.1 | ⚠ WEAK EVIDENCE\nSome text. More.\n\n"
        "[4] doi: | p.1\nSome text. More.\n"
    )
    assert refs == "**References:**\n• doi:10.1/a\n• doi:10.1/b *(weak evidence)*"
    empty = sources(spark, [])
    assert tuple(empty.select(P.build_context(F.col("s")), P.format_references(F.col("s"))).first()) == ("", "")


def test_prompts(spark):
    df = sources(spark, [source(1, "10.1/a", 0.2)])
    for label, gap in (("SUPPORTED", False), ("INFERRED", True)):
        messages, prompt = df.select(
            P.build_messages(F.lit("Why?"), F.col("s"), F.lit(label)), P.build_prompt(F.lit("Why?"), F.col("s"), F.lit(label))
        ).first()
        context = "[1] doi:10.1/a | p.1\nSome text. More.\n"
        note = f"\n\n{vocab.GAP_NOTE}" if gap else ""
        assert [m["role"] for m in messages] == ["system", "user"]
        assert messages[1]["content"] == f"RETRIEVED SOURCES:\n\n{context}\n{note}\nQUESTION: Why?"
        note = f"\n{vocab.GAP_NOTE}\n" if gap else ""
        assert prompt == (
            f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{vocab.SYSTEM_PROMPT}<|eot_id|>"
            f"<|start_header_id|>user<|end_header_id|>\nRETRIEVED SOURCES:\n\n{context}\n{note}QUESTION: Why?<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n"
        )


def test_rerank(spark):
    rows = [(1, "q", f"t{i}", 0.1 * i, i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id int, question string, text string, distance double, rank int")
    df = df.withColumn("rerank_score", F.lit(None).cast("double"))

    def order(scorer, k=3):
        return [r["text"] for r in R.rerank(df, scorer, k).orderBy("rank").collect()]

    assert order(None) == ["t1", "t2", "t3"]
    assert order(lambda q, t: F.when(t == "t5", 2.0).otherwise(1.0)) == ["t5", "t1", "t2"]
    assert order(R.cross_encoder_score("no-such-model")) == ["t1", "t2", "t3"]


def test_lexical_score(spark):
    df = spark.createDataFrame([("The bean, the BEAN rust", "rust on a bean"), ("", "x"), ("a b", "")], "q string, t string")
    got = [r[0] for r in df.select(R.lexical_score(F.col("q"), F.col("t"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0]


# -- whole chain -----------------------------------------------------------------


@pytest.fixture(scope="module")
def collection(spark):
    from sparquill.operators.encoding import encode_chunks

    texts = ["Drought reduces seed yield. Much.", "Rust is a leaf disease.", "Nitrogen fixation by Rhizobium.", "Unrelated words only"]
    rows = [(i, t, f"10.1_p{i % 2}.pdf", "1961-2006" if i < 2 else "2007-2026", i, "results") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, document string, source_file string, year_range string, page_number int, section string")
    return encode_chunks(df, text="document").cache()


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")


def test_answers_and_routes(spark, collection):
    asked = questions(spark, "drought reduces seed yield", " ", "Hello!", "zzz qqq")
    rows = {r["query_id"]: r for r in A.answer(A.retrieve(asked, collection), routed=True).collect()}
    assert [rows[i]["route"] for i in range(4)] == ["answer", "blank", "greeting", "out_of_scope"]
    assert rows[0]["answer"] == "Drought reduces seed yield. (doi:10.1/p0, p.0)"
    assert rows[0]["references"].startswith("**References:**\n• doi:10.1/p0")
    assert rows[0]["sources"][0]["year_range"] == "1961-2006" and rows[0]["n_candidates"] == 20
    assert [rows[i]["answer"] for i in (1, 2, 3)] == ["", vocab.WELCOME_MESSAGE, vocab.OUT_OF_SCOPE_MESSAGE]
    assert rows[1]["references"] == ""


def failing(fault, calls=None):
    def ask(text):
        raise RuntimeError(fault)

    run = P._calling(ask)
    return lambda prompt, messages, found: run(prompt)


def test_generation_failures_become_text(spark, collection):
    retrieved = A.retrieve(questions(spark, "rust leaf disease"), collection)
    plain = A.answer(retrieved, failing("no route")).first()
    assert plain["answer"] == f"[LLM ERROR] no route. Retrieval succeeded with confidence={plain['confidence']}."
    routed = A.answer(retrieved, failing("HTTP 429"), routed=True).first()
    assert routed["answer"] == "⚠️ Rate limit reached. Please wait and try again." and routed["references"] == ""
    assert A.batch_summary(A.answer(retrieved, failing("x"))).first()["successful"] == 1  # the failure is answer text


def test_routing_comes_before_the_search(spark, collection):
    asked = questions(spark, "hello", "   ", "rust leaf disease")
    every, routed = A.retrieve(asked, collection), A.retrieve(asked, collection, routed=True)
    assert sorted(len(r["sources"]) > 0 for r in routed.collect()) == [False, False, True]
    plain = sorted((r["query_id"], r["route"], r["answer"]) for r in A.answer(every, routed=True).collect())
    assert plain == sorted((r["query_id"], r["route"], r["answer"]) for r in A.answer(routed, routed=True).collect())


def test_service_requests(spark, collection, monkeypatch):
    def post(url, payload, headers, timeout):
        if "messages" in payload:
            said = [m["role"] for m in payload["messages"]]
            return {"choices": [{"message": {"content": f" {said} {payload['max_tokens']} {headers['Authorization']} "}}]}
        return {"response": f" {payload['model']} {payload['options']['num_predict']} {payload['prompt'][:17]} "}

    monkeypatch.setattr(P, "_post", post)
    retrieved = A.retrieve(questions(spark, "rust leaf disease"), collection)
    prompt = A.answer(retrieved, P.prompt_service_generator("http://x/api", "m1")).first()
    assert prompt["answer"] == "m1 1024 <|begin_of_text|>"
    chat = A.answer(retrieved, P.chat_service_generator("http://x/api", "m2", "t0"), routed=True).first()
    assert chat["answer"] == "['system', 'user'] 1024 Bearer t0" and chat["references"].startswith("**References:**")


def test_generator_is_not_called_off_topic(spark, collection):
    retrieved = A.retrieve(questions(spark, "hi", "zzz qqq"), collection)
    rows = A.answer(retrieved, failing("must not be called"), routed=True).collect()
    assert all(r["error"] is None for r in rows)


def test_services_are_only_reached_when_asked():
    assert P.service_is_up("http://127.0.0.1:9/none", timeout=0.2) is False


def test_year_filter_and_no_candidates(spark, collection):
    asked = questions(spark, "nitrogen fixation")
    only = A.retrieve(asked, collection, where={"year_range": "1961-2006"}).first()
    assert {s["year_range"] for s in only["sources"]} == {"1961-2006"}
    none = A.retrieve(asked, collection, where={"year_range": "1800"}).first()
    assert none["sources"] == [] and none["confidence"] == "UNSUPPORTED"
    answer = A.answer(A.retrieve(asked, collection, where={"year_range": "1800"}), routed=True).first()
    assert answer["route"] == "out_of_scope"


def test_question_sources(spark, tmp_path):
    assert A.default_questions(spark).count() == 12
    path = tmp_path / "q.json"
    path.write_text('["a?", "b\\n?"]')
    assert [tuple(r) for r in A.read_questions(spark, str(path)).collect()] == [(0, "a?"), (1, "b\n?")]


def test_written_answers(spark, collection, tmp_path):
    answers = A.answer(A.retrieve(A.default_questions(spark), collection), tasks=3)
    A.write_answers(answers, str(tmp_path), {"model": "extractive", "top_k": 6})
    run = spark.read.json(f"{tmp_path}/run").first()
    assert run["configuration"]["top_k"] == 6 and run["configuration"]["seconds"] > 0 and run["statistics"]["total_questions"] == 12
    assert spark.read.json(f"{tmp_path}/summary").first()["total_questions"] == 12
    assert spark.read.json(f"{tmp_path}/results").count() == 12


def test_benchmark(spark, collection, tmp_path):
    from sparquill.plans import evaluating as E

    assert E.benchmark(spark).count() == 25
    assert {r[0]: r[1] for r in E.benchmark(spark).groupBy("category").count().collect()} == {
        c: 5 for c in ("direct_lookup", "cross_section", "inference", "critique", "multi_part")
    }
    scored = E.evaluate(spark, collection, categories=["inference", "critique"])
    E.write_report(scored, str(tmp_path))
    summary = spark.read.json(f"{tmp_path}/summary").first()
    assert summary["total_questions"] == summary["successful"] == 10 and 0 <= summary["avg_rubric_coverage"] <= 1
    assert summary["doi_citation_rate"] == 0.0  # these sources have no four-digit registrant
    labels = {r["confidence"]: r["n_answers"] for r in spark.read.json(f"{tmp_path}/confidence").collect()}
    assert set(labels) == set(vocab.CONFIDENCE_LABELS) and sum(labels.values()) == 10
    assert spark.read.json(f"{tmp_path}/by_category").count() == 2


def test_summary_without_any_success(spark):
    from sparquill.operators import evaluation as V

    rows = spark.createDataFrame(
        [("c", None, None, None, "failed")],
        "category string, rubric_coverage double, has_doi_citation boolean, has_confidence_label boolean, error string",
    )
    assert tuple(V.overall(rows).first()) == (1, 0, 0.0, 0.0, 0.0)
    assert V.by_category(rows).count() == 0


def test_session(spark, collection):
    from sparquill.plans.session import Session

    s = Session(collection)
    assert s.feed("  ") is None and s.feed("/help") == vocab.SESSION_HELP
    assert s.feed("/year 1999").startswith("Valid options") and s.year_filter is None
    assert s.feed("/year 2007-2026") == "Year filter: 2007-2026"
    assert s.feed("/sources x") == "Usage: /sources <number>" and s.feed("/sources 1") == "Sources set to: 1"
    row = s.feed("nitrogen fixation by Rhizobium").first()
    assert len(row["sources"]) == 1 and row["sources"][0]["year_range"] == "2007-2026" and row["year_filter"] == "2007-2026"
    assert s.feed("/year off") == "Year filter removed." and s.year_filter is None
    assert s.feed("/quit") == "Bye!" and s.finished


def test_a_failing_scorer_keeps_the_order_by_distance(spark, monkeypatch):
    import sys
    import types

    from pyspark.sql import functions as F

    from sparquill.operators import retrieval as R

    data = [(q, r, 0.1 * r, f"{'broken' if q == 2 and r == 2 else 'text'} {9 - r}") for q in (1, 2) for r in range(1, 5)]
    rows = spark.createDataFrame(data, "query_id int, rank int, distance double, text string").withColumn("question", F.lit("q"))
    scorer = lambda q, t: F.when(~t.startswith("broken"), F.substring(t, 6, 1).cast("double") * -1)
    ranked = R.rerank(rows, scorer, 3).orderBy("query_id", "rank").collect()
    assert [r["distance"] for r in ranked] == [0.4, 0.1 * 3, 0.2, 0.1, 0.2, 0.1 * 3]
    assert [r["rerank_score"] is None for r in ranked] == [False] * 3 + [True] * 3

    # the model itself fails on some pairs
    class CrossEncoder:
        def __init__(self, *_, **__):
            pass

        def predict(self, pairs):
            raise RuntimeError("out of memory")

    module = types.ModuleType("sentence_transformers")
    module.CrossEncoder = CrossEncoder
    monkeypatch.setitem(sys.modules, "sentence_transformers", module)
    score = R.cross_encoder_score("any")
    assert [r["rank"] for r in R.rerank(rows, score, 2).orderBy("query_id", "rank").collect()] == [1, 2, 1, 2]
