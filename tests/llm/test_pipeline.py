"""The pipeline against a plain-Python form of its SQL-less stages, on a small folder of its own."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from sparquill.llm.queries import ORACLES, QUERIES
from sparquill.session import checkpointed
from tests.llm.helpers import brute_components, documents, prose, rows
from tests.llm.test_dedup import _brute_lines
from tests.llm.test_models import INSULTS


def _folder(spark, tmp_path):
    notice = prose(900, 60)
    values, toxic = [], []
    for i in range(240):
        lines = [prose(2000 + 10 * i + j, 12) for j in range(1 + i % 4)]
        if i % 6 == 0:
            lines.insert(0, notice)
        if i % 5 == 2:
            lines[-1] += " " + INSULTS[i % 4]
        toxic.append(int(i % 5 == 2))
        values.append("\n".join(lines))
    values += [values[1], values[3] + " more", None, "", values[8]]
    docs = documents(spark, values).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return values, toxic


def test_stages(spark, tmp_path):
    values, toxic = _folder(spark, tmp_path)
    assert [name for name, _ in C.STAGES] == [
        "toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in C.STAGES[:-1]:
        path = f"{tmp_path}/stage{len(kept)}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in rows(docs)})
    clean, lines, near, mixed = kept
    bad = {i for i, t in enumerate(values) if re.search("|".join(INSULTS), t or "")}
    assert not bad & set(clean) and len(clean) >= 0.98 * (len(values) - len(bad))
    want = _brute_lines(list(clean.values()), list(clean))
    assert {i: t or "" for i, t in lines.items()} == {i: w[2] for i, w in want.items()}
    components = brute_components(list(lines.values()), list(lines))
    assert set(near) == {i for i, (_, top) in components.items() if i == top}
    assert set(mixed) <= set(near)
    assert all(r["n_chars"] == len(r["text"]) for r in rows(docs))

    packed = rows(C.run(spark, str(tmp_path)))
    assert {r["doc_id"] for r in packed} == set(mixed)
    for r in packed:
        if r["n_pieces"] == 1:
            assert r["text"] == mixed[r["doc_id"]]


def test_columns_of_any_name_and_empty_tables_pass_all_stages(spark, tmp_path):
    values, toxic = _folder(spark, tmp_path)
    names = ["_score", "score", "_hash", "_id", "row", "digest", "_row", "component_id", "size", "bin", "text_md5", "copies", "kept"]
    docs = documents(spark, values).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in names])
    empty = docs.limit(0)
    for _, stage in C.STAGES[:-1]:
        docs, empty = checkpointed(stage(spark, docs, str(tmp_path))), checkpointed(stage(spark, empty, str(tmp_path)))
        assert docs.columns == empty.columns and docs.count() > 0 and empty.count() == 0
        assert {tuple(r[n] for n in names) for r in rows(docs)} == {tuple(names)}
    assert C.pack_sequences(spark, docs, str(tmp_path)).count() > 0 and C.pack_sequences(spark, empty, str(tmp_path)).count() == 0


def test_ids_of_another_type(spark):
    from sparquill.llm import exact_dedup, license_scan, line_dedup, near_dedup, packing, secret_scan, sharding, source_mix

    docs = documents(spark, [prose(1), prose(1) + " x", "password = hunter2hunter2", "MIT", None]).withColumn("doc_id", F.col("doc_id").cast("int"))
    runs = [
        exact_dedup.exact_dedup, license_scan.license_scan, line_dedup.line_dedup, near_dedup.near_dedup, near_dedup.drop_near_copies,
        packing.pack, secret_scan.secret_scan, sharding.shard_documents, source_mix.taken_words, source_mix.mixed_documents,
    ]
    for run in runs:
        assert len(run(docs).collect()) >= 3, run.__name__


def test_every_number_is_registered():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(ORACLES) <= set(QUERIES)
