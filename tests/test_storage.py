import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquill.operators.encoding import encode_chunks, hashing_encoder
from sparquill.plans import embedding, ingest, store
from sparquill.sources import chunk_files, documents
from sparquill.sources.collections import Collections, folder_size
from sparquill.streaming.ingest import stream_ingest


def form_feed_reader():
    """Plain text with form feeds between pages, behind a PDF signature."""

    def page(text):
        if "BROKEN" in text:
            raise ValueError("broken page")
        return text

    def read(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        return [lambda t=t: page(t) for t in content[4:].decode().split("\f")]

    return read


def write_pdf(folder, name, *pages):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"%PDF" + "\f".join(pages).encode())


@pytest.fixture
def corpus(tmp_path):
    root = str(tmp_path / "corpus")
    write_pdf(f"{root}/1961-2006", "10.1000_a.pdf", "Abstract\nFirst page text is here.", "Results\nx | y\nSecond page.")
    write_pdf(f"{root}/2007-2026/deep", "10.1000_b.PDF", "Some words that are long enough to keep.", "BROKEN", "Third page.")
    write_pdf(f"{root}/2007-2026", "short.pdf", "")
    with open(f"{root}/2007-2026/bad.pdf", "wb") as f:
        f.write(b"garbage")
    with open(f"{root}/notes.txt", "w") as f:
        f.write("not a document")
    os.makedirs(tmp_path / "elsewhere")
    write_pdf(str(tmp_path / "elsewhere"), "linked.pdf", "Linked text is found too.")
    os.symlink(tmp_path / "elsewhere", f"{root}/link")
    return root


def names(files):
    return sorted(os.path.basename(r["path"]) for r in files.select("path").collect())


def test_discovery(spark, corpus):
    assert names(documents.find_files(spark, corpus)) == ["10.1000_a.pdf", "10.1000_b.PDF", "bad.pdf", "linked.pdf", "short.pdf"]
    assert "10.1000_b.PDF" not in names(documents.find_files(spark, corpus, case_sensitive=True))


def test_audit(spark, corpus):
    files = documents.find_files(spark, corpus)
    counts = {r["folder"].split("/")[-1]: r["n_files"] for r in documents.audit(files).collect()}
    assert counts == {"1961-2006": 1, "2007-2026": 2, "deep": 1, "link": 1}
    assert {os.path.basename(r["path"]) for r in documents.validity(files).where("not is_valid").collect()} == {"bad.pdf"}
    assert documents.sample_names(files, 1).where(F.col("folder").endswith("/2007-2026")).first()["name"] == "bad.pdf"


def test_extraction_and_ingest(spark, corpus, tmp_path):
    extracted = documents.extract(documents.find_files(spark, corpus), form_feed_reader).cache()
    rows = {os.path.basename(r["path"]): r for r in extracted.collect()}
    assert rows["bad.pdf"]["error"] == "not a PDF" and rows["bad.pdf"]["pages"] is None
    assert [p["number"] for p in rows["10.1000_b.PDF"]["pages"]] == [1, 3] and rows["10.1000_b.PDF"]["n_pages"] == 3
    chunks = ingest.ingest(extracted)
    got = {(r["source_file"], r["chunk_id"]): r for r in chunks.collect()}
    a0, a1, a2 = (got["10.1000_a.pdf", i] for i in range(3))
    assert (a0["text"], a0["section"], a0["year_range"]) == ("First page text is here.", "abstract", "1961-2006")
    assert a1["text"] == "x | y" and a1["section"] == "results" and a2["text"] == "Second page."
    assert got["10.1000_b.PDF", 0]["page_number"] == 3 and got["linked.pdf", 0]["year_range"] == "unknown"
    files = ingest.write_run(ingest.process(extracted), str(tmp_path / "run"), {"chunk_size": 512})
    assert spark.read.json(str(tmp_path / "run/run")).first()["configuration"]["chunk_size"] == 512
    assert spark.read.json(str(tmp_path / "run/chunks")).count() == 5 and spark.read.json(str(tmp_path / "run/errors")).count() == 1
    assert sorted(map(tuple, ingest.chunks_of(files).collect())) == sorted(map(tuple, chunks.collect()))
    assert [os.path.basename(r["file"]) for r in ingest.errors_of(files).collect()] == ["bad.pdf"]
    run = ingest.statistics(files).first()
    assert (run["total_pdfs"], run["successful"], run["failed"], run["total_chunks"], run["total_pages"]) == (5, 3, 2, 5, 7)
    texts = extracted.select("path", documents.T.mark_pages(F.col("pages")).alias("text"))
    stats = ingest.statistics(ingest.outcomes(texts)).first()
    assert (stats["total_pdfs"], stats["successful"], stats["failed"], stats["total_chunks"]) == (5, 3, 2, 5)
    assert stats["chunks_per_pdf"] == 1.7


def test_ocr_only_where_text_is_short(spark, corpus):
    files = documents.find_files(spark, corpus).where(F.col("path").endswith("b.PDF"))
    ocr = lambda: lambda content, page: f"recognised {page}" if page != 1 else None
    row = documents.extract(files, form_feed_reader, ocr).first()
    assert row["ocr_used"] == 1 and [(p["number"], p["body"][:12]) for p in row["pages"]] == [(1, "Some words t"), (3, "recognised 3")]


CHUNKS = [(f"Text number {i} about beans.", f"s{i % 3}.pdf", "1961-2006" if i % 2 else "2028", i, 1, 6, "") for i in range(9)]


@pytest.fixture
def chunks(spark):
    from sparquill.schemas import CHUNK

    return spark.createDataFrame(CHUNKS, CHUNK)


def test_chunk_files(spark, chunks, tmp_path):
    array = tmp_path / "chunks.json"
    array.write_text(json.dumps([r.asDict() for r in chunks.collect()], ensure_ascii=False))
    assert sorted(map(tuple, chunk_files.read_chunks(spark, str(array)).collect())) == sorted(CHUNKS)
    chunk_files.write_chunks(chunks, str(tmp_path / "out"))
    assert sorted(map(tuple, chunk_files.read_chunks(spark, str(tmp_path / "out"), lines=True).collect())) == sorted(CHUNKS)
    chunk_files.write_chunks(chunks.repartition(3), str(tmp_path / "files"))
    assert sorted(map(tuple, chunk_files.read_chunks(spark, str(tmp_path / "files")).collect())) == sorted(CHUNKS)
    (tmp_path / "files" / "array.json").write_text(json.dumps([r.asDict() for r in chunks.collect()], indent=1))
    assert sorted(map(tuple, chunk_files.read_chunks(spark, str(tmp_path / "files")).collect())) == sorted(CHUNKS * 2)
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    with pytest.raises(ValueError):
        chunk_files.read_chunks(spark, str(empty))
    stats = ingest.statistics(spark.createDataFrame([("p", 2, 3, True)], "path string, n_pages int, n_chunks int, succeeded boolean"))
    chunk_files.write_run_metadata(stats, str(tmp_path / "meta"), {"chunk_size": 512, "use_ocr": False})
    meta = spark.read.json(str(tmp_path / "meta")).first()
    assert meta["statistics"]["total_chunks"] == 3 and meta["configuration"]["chunk_size"] == 512


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    text = ['plain', 'a "quoted" word', 'braces } and { and }, {', 'back\\slash \\" }', 'line\nbreak ] [', '', 'ünï 東京 }{"']
    records = [{"id": i, "text": text[i % len(text)] * (i % 5), "inner": {"deep": {"n": i}, "s": "}"}} for i in range(3000)]
    schema = "id long, text string, inner struct<deep: struct<n: long>, s: string>"
    for n, indent in enumerate((None, 2)):
        with open(tmp_path / f"a{n}.json", "w") as f:
            json.dump(records, f, indent=indent, ensure_ascii=n == 0)
    with open(tmp_path / "empty.json", "w") as f:
        f.write("[ ]\n")
    schema = spark.createDataFrame([], schema).schema
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10007")
    try:
        for path in (f"{tmp_path}/a0.json", f"{tmp_path}/a1.json"):
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
            rows = chunk_files.read_json_arrays(spark, path, schema).collect()
            assert sorted((r.asDict(True) for r in rows), key=lambda r: r["id"]) == records
        assert chunk_files.read_json_arrays(spark, f"{tmp_path}/*.json", schema).count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(tmp_path / "cut.json", "w") as f:
        f.write('[{"source_file": "a.pdf", "text": "b')
    with pytest.raises(ValueError, match="no end of the array"):
        chunk_files.read_chunks(spark, f"{tmp_path}/cut.json")


def test_embedding_run(spark, chunks, tmp_path):
    passed, report = embedding.embed(chunks, str(tmp_path / "e"))
    assert passed and report["n_vectors"] == 9 and report["is_normalised"]
    run = spark.read.json(str(tmp_path / "e/run")).first()
    assert run["statistics"]["n_vectors"] == 9 and run["configuration"]["model"] == "feature-hashing"
    assert run["configuration"]["chunks_per_second"] > 0
    assert embedding.embed(chunks, str(tmp_path / "e"))[0]  # again, over the earlier ones
    stored = spark.read.parquet(str(tmp_path / "e/vectors"))
    assert [r[0] for r in stored.select("embedding_index").orderBy("source_file", "chunk_id").collect()] == list(range(9))

    def flaky():
        encode = hashing_encoder()()

        def run(texts):
            if any("number 4" in t for t in texts):
                raise ValueError("out of memory")
            return encode(texts)

        return run

    passed, report = embedding.embed(chunks, str(tmp_path / "f"), encoder=flaky, batch_size=1)
    assert not passed and report["n_vectors"] == 8 and not report["count_matches"]
    assert not os.path.exists(tmp_path / "f/vectors")
    assert sum(r["n_chunks"] for r in embedding.profile(stored, k=3).collect()) == 9


def test_collections(spark, chunks, tmp_path):
    db = Collections(spark, str(tmp_path / "db"))
    with pytest.raises(ValueError):
        db.open("papers")
    store.build(db, "papers", chunks, partition_by="year_range")
    assert db.count("papers") == 9 and db.attributes("papers")["embedding_model"] == "feature-hashing"
    ids = [r["id"] for r in db.open("papers").orderBy("source_file", "chunk_id").collect()]
    assert ids == [f"chunk_{i}" for i in range(9)]

    more = encode_chunks(chunks).withColumnRenamed("text", "document").drop("encode_error")
    db.add("papers", more, "source_file", "chunk_id")
    assert db.count("papers") == 18
    assert {r["id"] for r in db.open("papers").select("id").collect()} == {f"chunk_{i}" for i in range(18)}
    assert db.open("papers").count() == 18

    got = db.get("papers", ids=["chunk_0", "chunk_17", "none"], include=["document", "year_range"])
    assert got.columns == ["id", "document", "year_range"] and got.count() == 2
    assert db.get("papers", ids=spark.createDataFrame([("chunk_3",)], "id string")).count() == 1
    assert {r["year_range"] for r in db.get("papers", where={"year_range": "2028"}).collect()} == {"2028"}
    asked = encode_chunks(spark.createDataFrame([(1, "Text number 5 about beans.")], "query_id int, text string"))
    top = db.query("papers", asked, 2).orderBy("rank").first()
    assert top["document"] == "Text number 5 about beans." and top["distance"] == 0.0

    stats = db.statistics("papers").first()
    assert (stats["total_chunks"], stats["unique_sources"], stats["embedding_dimension"]) == (18, 3, 384)
    assert stats["size_mb"] == folder_size(spark, str(tmp_path / "db/papers")).first()["size_mb"] > 0
    db.save_statistics("papers")
    assert {r["name"]: r["n_chunks"] for r in db.list().collect()} == {"papers": 18}

    store.build(db, "papers", chunks.where("chunk_id < 3"))
    assert db.count("papers") == 3
    db.delete("papers")
    assert db.names() == []
    db.create("lists", "none")
    with pytest.raises(ValueError):
        db.add("lists", chunks.withColumn("tags", F.array(F.lit("x"))), "chunk_id")


def test_year_filter_prunes_folders(spark, chunks, tmp_path):
    db = Collections(spark, str(tmp_path / "db"))
    store.build(db, "papers", chunks, partition_by="year_range")
    plan = db.get("papers", where={"year_range": "2028"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_range" in plan.replace("\n", " ") and "2028" in plan


def test_streaming_ingest(spark, corpus, tmp_path):
    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "feature-hashing")

    def run():
        stream_ingest(spark, corpus, db, "papers", str(tmp_path / "progress"), form_feed_reader, files_per_batch=2).awaitTermination()
        return sorted((r["source_file"], r["chunk_id"], r["document"]) for r in db.open("papers").collect())

    first = run()
    extracted = documents.extract(documents.find_files(spark, corpus), form_feed_reader)
    assert first == sorted((r["source_file"], r["chunk_id"], r["text"]) for r in ingest.ingest(extracted).collect())
    assert run() == first  # nothing new
    write_pdf(f"{corpus}/2007-2026", "new.pdf", "A newly arrived document.")
    assert [r for r in run() if r not in first] == [("new.pdf", 0, "A newly arrived document.")]
    ids = [r["id"] for r in db.open("papers").collect()]
    assert sorted(ids, key=lambda i: int(i[6:])) == [f"chunk_{i}" for i in range(len(ids))]


def ids_are_dense(db, name):
    ids = [int(r["id"][6:]) for r in db.open(name).select("id").collect()]
    return sorted(ids) == list(range(db.count(name)))


def test_inserts_never_replace_each_other(spark, chunks, corpus, tmp_path):
    """Build, stream, a second stream with a new checkpoint, add, a repeated key: all rows stay."""
    db = Collections(spark, str(tmp_path / "db"))
    store.build(db, "papers", chunks)
    for progress in ("one", "two"):
        stream_ingest(spark, corpus, db, "papers", str(tmp_path / progress), form_feed_reader, files_per_batch=2).awaitTermination()
    streamed = (db.count("papers") - 9) // 2
    assert streamed > 0 and db.count("papers") == 9 + 2 * streamed
    rows = encode_chunks(chunks).withColumnRenamed("text", "document")
    for _ in range(2):  # the second one is a replay
        db.add("papers", rows, "source_file", "chunk_id", key="job-7")
    assert db.count("papers") == db.open("papers").count() == 18 + 2 * streamed and ids_are_dense(db, "papers")
    before = sorted((r["id"], r["document"]) for r in db.open("papers").collect())
    assert db.compact("papers")
    assert sorted((r["id"], r["document"]) for r in db.open("papers").collect()) == before
    kept = len(os.listdir(tmp_path / "db/papers/data"))
    assert kept > 2  # for readers that have begun with them
    db.add("papers", rows, "source_file", "chunk_id", key="job-7")  # a replay after the compaction
    assert sorted((r["id"], r["document"]) for r in db.open("papers").collect()) == before
    assert db.compact("papers") and len(os.listdir(tmp_path / "db/papers/data")) == 2
    db.add("papers", rows, "source_file", "chunk_id")
    assert ids_are_dense(db, "papers") and db.get("papers", ids=["chunk_3", f"chunk_{db.count('papers') - 1}"]).count() == 2


def test_two_adds_at_a_time(spark, chunks, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "none")
    rows = encode_chunks(chunks).withColumnRenamed("text", "document")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: db.add("papers", rows, "source_file", "chunk_id"), range(4)))
    assert db.count("papers") == db.open("papers").count() == 36 and ids_are_dense(db, "papers")


def test_two_writers_of_one_key(spark, chunks, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "none")
    rows = encode_chunks(chunks).withColumnRenamed("text", "document")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: db.add("papers", rows, "source_file", "chunk_id", key="same"), range(3)))
    assert db.count("papers") == db.open("papers").count() == 9 and ids_are_dense(db, "papers")
    assert len(os.listdir(tmp_path / "db/papers/data")) == 1


def test_a_stream_restarted_after_a_compaction(spark, corpus, tmp_path):
    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "feature-hashing")

    def run():
        stream_ingest(spark, corpus, db, "papers", str(tmp_path / "progress"), form_feed_reader, files_per_batch=2).awaitTermination()
        return sorted((r["id"], r["document"]) for r in db.open("papers").collect())

    first = run()
    assert db.compact("papers")
    # the last batch is stored, but the stream does not know: its commit is lost
    commits = sorted(f for f in os.listdir(tmp_path / "progress/commits") if f.isdigit())
    for f in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(tmp_path / "progress/commits" / f)
    assert run() == first


def _scans(df):
    """(files read, dynamic partition filter or not) of every Parquet scan of an executed plan."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and "/data" in node.toString() + node.relation().location().toString():
            filters = node.partitionFilters().toString()
            found.append((node.metrics().apply("numFiles").value(), "dynamicpruning" in filters))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_looked_up_documents_come_from_few_files(spark, monkeypatch, tmp_path):
    from sparquill.operators.knn import knn
    from sparquill.plans import answering
    from sparquill.sources import collections as C

    monkeypatch.setattr(C, "BLOCK_ROWS", 50)
    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "none")
    rows = spark.range(1000).selectExpr(
        "id AS n", "concat('Text ', id) AS document", "concat('f', id) AS source_file", "'2001' AS year_range", "1 AS page_number", "'' AS section",
        "array(float(cos(id / 1000)), float(sin(id / 1000))) AS embedding",
    )
    for part in (0, 1):
        db.add("papers", rows.where(F.col("n") % 2 == part), "n")
    stored = db.open("papers")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9999995, 0.001])], "query_id int, embedding array<float>")
    want = sorted(map(tuple, knn(asked, stored, 5, columns=("document",)).collect()))
    for look_up_twice in range(2):
        found = knn(asked, db.open("papers"), 5, columns=("document",), look_up=db.look_up_in("papers"))
        scans = _scans(found)
        assert sorted(map(tuple, found.collect())) == want
        pruned = [n for n, dynamic in scans if dynamic]
        files = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "db/papers/data") for f in names)
        assert len(pruned) == 1 and pruned[0] <= 3 and files >= 20
        assert look_up_twice or db.compact("papers")
    some = db.get("papers", ids=["chunk_3", "chunk_999", "chunk_07", "chunk_1000", "x", "chunk_3"])
    assert sorted(r["id"] for r in some.collect()) == ["chunk_3", "chunk_999"]
    assert [n for n, dynamic in _scans(some) if dynamic][0] <= 4
    # more ids than are broadcast
    monkeypatch.setattr(C, "MAX_LOOKED_UP", 3)
    ids = spark.createDataFrame([(f"chunk_{i}",) for i in range(0, 1000, 100)], "id string")
    assert db.get("papers", ids=ids).count() == 10
    questions = spark.createDataFrame([(1, "Text 5?")], "query_id int, question string")
    encoder = lambda: lambda texts: [[1.0, 0.0]] * len(texts)
    plain = answering.retrieve(questions, db.open("papers"), encoder=encoder)
    pruned = answering.retrieve(questions, db.open("papers"), encoder=encoder, look_up=db.look_up_in("papers"))
    assert plain.collect() == pruned.collect() and len(plain.first()["sources"]) == 10


def test_failed_rows_are_counted_and_listed(spark, chunks, tmp_path):
    def flaky():
        encode = hashing_encoder()()

        def run(texts):
            if any("number 4" in t for t in texts):
                raise ValueError("out of memory")
            return encode(texts)

        return run

    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "flaky")
    db.add("papers", encode_chunks(chunks, encoder=flaky, batch_size=1).withColumnRenamed("text", "document"), "source_file", "chunk_id")
    assert db.count("papers") == 8 and ids_are_dense(db, "papers")
    (bad,) = db.errors("papers").collect()
    assert bad["chunk_id"] == 4 and "out of memory" in bad["encode_error"]
    assert db.statistics("papers").first()["failed_chunks"] == 1


def test_partition_values_keep_their_type(spark, chunks, tmp_path):
    db = Collections(spark, str(tmp_path / "db"))
    db.create("papers", "none", partition_by="year_range")
    rows = encode_chunks(chunks.withColumn("year_range", F.lit("007"))).withColumnRenamed("text", "document")
    db.add("papers", rows, "source_file", "chunk_id")
    assert {r["year_range"] for r in db.open("papers").collect()} == {"007"}


def test_intermediates_are_deleted(spark, chunks, tmp_path):
    from sparquill.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(root) if f.startswith("written-")}
    store.build(Collections(spark, str(tmp_path / "db")), "papers", chunks)
    assert {f for f in os.listdir(root) if f.startswith("written-")} == before


def test_read_files_are_handed_on_before_a_batch_is_over(monkeypatch):
    def read(content):
        if content == b"bad":
            raise ValueError("not a document")
        return [lambda: content.decode(), lambda: None]

    files = [b"x" * 400, b"bad", b"", b"y" * 700] * 25
    batches = [pa.array(files[:60], pa.binary()), pa.array([], pa.binary()), pa.array(files[60:], pa.binary())]
    monkeypatch.setattr(documents, "HELD_BYTES", 1000)
    parts = list(documents._read_batches(iter(batches), read, None))
    assert max(sum(len(p["body"]) for r in part.to_pylist() for p in r["pages"] or []) for part in parts) < 1000 + 700
    rows = [r for part in parts for r in part.to_pylist()]
    assert [r["n_pages"] for r in rows] == [2, 0, 2, 2] * 25
    assert [(r["pages"] or [{}])[0].get("body") if r["pages"] else r["error"] for r in rows] == ["x" * 400, "not a document", None, "y" * 700] * 25
