"""Stored collections: Parquet tables of vectors, documents and scalar metadata.

A collection is a folder.  Every insert has a key of its own and is written to its own folder below
``data``.  It counts only once the next numbered file below ``manifest`` names it: that file is created
exclusively and last, and gives the insert's first id and row count.  So two inserts at a time take different ids and never
touch each other's rows, an insert that breaks off leaves nothing visible, and one that is
repeated under its key is recognised, also after a compaction.  Stored rows carry their number within the insert; ids are first id plus
number.  Within an insert, rows lie in folders of ``BLOCK_ROWS`` consecutive numbers, so that a look-up of ids reads only the folders
that hold one.  Rows whose encoding failed are kept apart and counted.  ``about`` holds the collection's attributes.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.operators.filters import where_to_column
from sparquill.operators.indexing import dense_index
from sparquill.operators.knn import knn
from sparquill.schemas import COLLECTION_CORE, SCALAR_TYPES
from sparquill.session import checkpointed, stored_for_now

ID_PREFIX = "chunk_"
BLOCK_ROWS = 1 << 16  # consecutive rows in one folder
MAX_LOOKED_UP = 1 << 19  # ids sent to every task; more are shuffled
FAILED = ("source_file", "chunk_id", "year_range", "encode_error")  # what is kept of a row that could not be encoded
_commits = threading.Lock()  # exclusive creation is not exclusive enough between threads on a local disk


def number_rows(rows: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """Add ids ``chunk_<n>``, dense over all rows in the given order."""
    numbered = dense_index(rows, *order, name="_n", start=start)
    return numbered.select(F.concat(F.lit(ID_PREFIX), F.col("_n").cast("string")).alias("id"), *rows.columns)


def append_rows(stored: DataFrame, added: DataFrame, *order: str) -> DataFrame:
    """``stored`` plus ``added``, whose ids continue from the stored count."""
    return stored.unionByName(number_rows(added, *order, start=stored.count()))


def check_metadata(rows: DataFrame) -> None:
    """Metadata must be scalar: lists and structs cannot be filtered on."""
    bad = [
        f.name
        for f in rows.schema.fields
        if f.name not in COLLECTION_CORE and not isinstance(f.dataType, SCALAR_TYPES)
    ]
    if bad:
        raise ValueError(f"metadata fields must be scalar: {', '.join(bad)}")


class Collections:
    """The collections below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- folders

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _children(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    # -- life cycle

    def create(
        self, name: str, embedding_model: str, description: str = "", partition_by: str | None = None
    ) -> None:
        """An empty collection; one of the same name is replaced.

        Filters on the ``partition_by`` field skip whole folders.
        """
        self.delete(name)
        attributes = {
            "name": name,
            "description": description,
            "embedding_model": embedding_model,
            "creation_date": datetime.now(timezone.utc).isoformat(),
            "partition_by": partition_by,
        }
        schema = "name string, description string, embedding_model string, creation_date string, partition_by string"
        self.spark.createDataFrame([attributes], schema).coalesce(1).write.mode("overwrite").json(f"{self._folder(name)}/about")

    def delete(self, name: str) -> None:
        self._delete(self._folder(name))

    def names(self) -> list[str]:
        return [c for c in self._children(self.root) if not c.startswith("_")]

    def list(self) -> DataFrame:
        """``(name, n_chunks)`` of every collection."""
        counts = [(name, self.count(name)) for name in self.names()]  # from the manifests, without a job
        return self.spark.createDataFrame(counts, "name string, n_chunks long")

    def attributes(self, name: str) -> dict[str, Any]:
        return json.loads(self.spark.read.text(f"{self._folder(name)}/about").first()[0])

    # -- the manifest

    def _entry(self, name: str, version: str) -> dict[str, Any]:
        fs, path = self._fs(f"{self._folder(name)}/manifest/{version}")
        for _ in range(50):  # another writer may have created, but not yet filled it
            stream = fs.open(path)
            text = _read(self.spark, stream)
            if text.endswith("\n"):
                return json.loads(text)
            time.sleep(0.1)
        raise RuntimeError(f"manifest entry {version} of {name!r} was never completed")

    def _versions(self, name: str) -> list[str]:
        return [v for v in self._children(f"{self._folder(name)}/manifest") if not v.startswith(".")]

    def _last(self, name: str) -> dict[str, Any]:
        """The newest entry; it has the totals, so the others need not be read."""
        versions = self._versions(name)
        empty = {"version": -1, "since": 0, "total": 0, "failed_total": 0, "schema": None}
        return self._entry(name, versions[-1]) if versions else empty

    def _entries(self, name: str) -> DataFrame:
        """All entries, also of inserts that a compaction has replaced."""
        schema = "version long, batch string, key string, first long, rows long"
        return self.spark.read.schema(schema).json(f"{self._folder(name)}/manifest")

    def _manifest(self, name: str) -> DataFrame:
        """``(batch, first, rows)`` of every insert that counts."""
        return self._entries(name).where(F.col("version") >= self._last(name)["since"]).select("batch", "first", "rows")

    def _counted(self, name: str, key: str | None) -> bool:
        """Whether an insert with this key was ever made visible."""
        return key is not None and bool(self._versions(name)) and not self._entries(name).where(F.col("key") == key).isEmpty()

    def _commit(
        self, name: str, batch: str, rows: int, failed: int, schema: T.StructType, replaces: int | None = None, key: str | None = None
    ) -> bool:
        """Make an insert visible; False if its key counts already, or if a compaction was overtaken by another insert."""
        while True:
            with _commits:
                last = self._last(name)
                if replaces is not None and last["version"] != replaces:
                    return False
                if self._counted(name, key):  # looked at again before each try: another writer may have had the same key
                    return False
                version = last["version"] + 1
                compacted = replaces is not None
                entry = {
                    "version": version,
                    "batch": batch,
                    "key": key,
                    "first": 0 if compacted else last["total"],
                    "rows": rows,
                    "since": version if compacted else last["since"],
                    "total": rows if compacted else last["total"] + rows,
                    "failed_total": last["failed_total"] + failed,
                    "schema": _merged(last["schema"], schema),
                }
                fs, path = self._fs(f"{self._folder(name)}/manifest/{version:09d}")
                try:
                    stream = fs.create(path, False)
                except Exception:
                    if not fs.exists(path):
                        raise
                    continue  # another writer was faster: take the next number
                stream.write(bytearray((json.dumps(entry) + "\n").encode()))
                stream.close()
                return True

    # -- rows

    def add(self, name: str, rows: DataFrame, *order: str, key: str | None = None) -> None:
        """Insert rows without ids; ids continue from the present count, in ``order``.

        With a ``key``, an insert that already counts under that key is not repeated.  A column ``encode_error``
        sets rows apart that failed.  The rows are stored before they are numbered, so that an encoder runs once.
        """
        check_metadata(rows.drop("encode_error"))
        if self._counted(name, key):
            return
        batch = "b-" + uuid.uuid4().hex  # also with a key: two writers of one key never share a folder
        partition_by = self.attributes(name).get("partition_by")
        with stored_for_now(rows) as stored:
            good, n_failed = stored, 0
            if "encode_error" in stored.columns:
                bad = stored.where(F.col("encode_error").isNotNull())
                good = stored.where(F.col("encode_error").isNull()).drop("encode_error")
                bad = bad.select(*[c for c in FAILED if c in stored.columns])
                bad.write.mode("overwrite").parquet(f"{self._folder(name)}/failed/batch={batch}")
                n_failed = bad.count()
            n = good.count()
            numbered = _in_blocks(dense_index(good, *order, name="row_no"))
            self._write(name, batch, numbered, partition_by)
        if not self._commit(name, batch, n, n_failed, numbered.schema, key=key):
            for part in ("data", "failed"):
                self._delete(f"{self._folder(name)}/{part}/batch={batch}")

    def _write(self, name: str, batch: str, numbered: DataFrame, partition_by: str | None) -> None:
        folders = [c for c in (partition_by, "row_block") if c]
        numbered.write.mode("overwrite").partitionBy(*folders).parquet(f"{self._folder(name)}/data/batch={batch}")

    def _delete(self, path: str) -> None:
        fs, folder = self._fs(path)
        fs.delete(folder, True)

    def _stored(self, name: str) -> DataFrame:
        """All rows that count, with ``batch``, ``row_no`` and ``first``."""
        last = self._last(name)
        if last["version"] < 0:
            raise ValueError(f"collection {name!r} is empty or does not exist")
        # the stored types: names of partition folders like "007" must not turn into numbers
        schema = T.StructType.fromJson(json.loads(last["schema"])).add("batch", T.StringType())
        rows = self.spark.read.schema(schema).parquet(f"{self._folder(name)}/data")
        return rows.join(self._manifest(name).drop("rows"), "batch")

    def open(self, name: str) -> DataFrame:
        """All rows, or an error if nothing was ever stored under the name."""
        rows = self._stored(name)
        number = (F.col("first") + F.col("row_no")).cast("string")
        others = [c for c in rows.columns if c not in ("batch", "first", "row_no", "row_block")]
        return rows.select(F.concat(F.lit(ID_PREFIX), number).alias("id"), *others)

    def count(self, name: str) -> int:
        return self._last(name)["total"]

    def errors(self, name: str) -> DataFrame:
        """``(batch, source_file, chunk_id, year_range, encode_error)`` of the rows that failed, as far as they had these."""
        schema = "batch string, source_file string, chunk_id int, year_range string, encode_error string"
        fs, folder = self._fs(f"{self._folder(name)}/failed")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], schema)
        since = self.spark.read.schema("batch string").json(f"{self._folder(name)}/manifest")
        return self.spark.read.schema(schema).parquet(f"{self._folder(name)}/failed").join(since, "batch", "left_semi")

    def compact(self, name: str) -> bool:
        """Rewrite all inserts as one, with the same ids; False if an insert came in between.

        What it replaces stays for readers that have begun with it, and goes with the next compaction.
        """
        last = self._last(name)
        rows = _in_blocks(self._stored(name).withColumn("row_no", F.col("first") + F.col("row_no")).drop("first", "batch", "row_block"))
        replaced_before = [r["batch"] for r in self._entries(name).where(F.col("version") < last["since"]).toLocalIterator()]
        batch = "b-" + uuid.uuid4().hex
        ordered = rows.repartitionByRange("row_no").sortWithinPartitions("row_no")
        self._write(name, batch, ordered, self.attributes(name).get("partition_by"))
        if not self._commit(name, batch, last["total"], 0, rows.schema, replaces=last["version"]):
            self._delete(f"{self._folder(name)}/data/batch={batch}")
            return False
        for old in replaced_before:
            self._delete(f"{self._folder(name)}/data/batch={old}")
        return True

    def get(
        self, name: str, ids: list[str] | DataFrame | None = None, where: dict[str, Any] | None = None,
        include: list[str] | None = None,
    ) -> DataFrame:
        """Rows by id and filter.  Ids reach the scan as folders and numbers: others are not read."""
        condition = where_to_column(where)
        if ids is None:
            rows = self.open(name)
        else:
            if not isinstance(ids, DataFrame):
                ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
            wanted = checkpointed(ids.select("id").distinct())
            rows = self.look_up(name, wanted, small=wanted.count() <= MAX_LOOKED_UP)
        if condition is not None:
            rows = rows.where(condition)
        return rows.select("id", *include) if include else rows

    def look_up(self, name: str, found: DataFrame, columns: tuple[str, ...] | None = None, small: bool = True) -> DataFrame:
        """``found``, which has an id, with ``columns`` (or all) of the rows stored under its ids; unknown ids vanish.

        The place of an id (insert, block of rows, number) follows from the manifest alone.  Where ``found`` is ``small``, it is
        computed now (a search must not run again to prune), its places are broadcast, and the blocks among them are
        all that the scan lists: dynamic partition pruning.
        """
        last = self._last(name)
        if last["version"] < 0:
            raise ValueError(f"collection {name!r} is empty or does not exist")
        schema = T.StructType.fromJson(json.loads(last["schema"])).add("batch", T.StringType())
        rows = self.spark.read.schema(schema).parquet(f"{self._folder(name)}/data")
        if small:
            found = checkpointed(found)
        number = F.expr(f"try_cast(substring(id, {len(ID_PREFIX) + 1}) AS bigint)")
        # the pattern is that of stored ids, so "chunk_07" is none
        known = found.where(F.col("id").rlike(f"^{ID_PREFIX}(0|[1-9][0-9]{{0,17}})$")).withColumn("_n", number)
        inserts = F.broadcast(self._manifest(name))  # a row for each insert since the last compaction
        places = known.join(inserts, (F.col("_n") >= F.col("first")) & (F.col("_n") < F.col("first") + F.col("rows")))
        places = _in_blocks(places.withColumn("row_no", F.col("_n") - F.col("first"))).drop("_n", "first", "rows")
        taken = [c for c in rows.columns if c not in ("batch", "row_no", "row_block")] if columns is None else list(columns)
        stored = rows.select("batch", "row_block", "row_no", *taken)
        joined = stored.join(F.broadcast(places) if small else places, ["batch", "row_block", "row_no"])
        return joined.select(*found.columns, *taken)

    def look_up_in(self, name: str) -> Callable[..., DataFrame]:
        """``look_up`` for one collection, as ``knn`` and ``answering.retrieve`` take it."""
        return partial(self.look_up, name)

    def query(self, name: str, queries: DataFrame, n_results: int, where: dict[str, Any] | None = None,
              include: tuple[str, ...] = ("document",), **options: Any) -> DataFrame:
        return knn(queries, self.open(name), n_results, where, columns=include, look_up=self.look_up_in(name), **options)

    # -- statistics

    def statistics(self, name: str) -> DataFrame:
        """One row: chunks, sources, dimension, years and size on disk."""
        rows = self.open(name)
        totals = rows.agg(
            F.count(F.lit(1)).alias("total_chunks"),
            F.lit(self._last(name)["failed_total"]).alias("failed_chunks"),
            F.max(F.size("embedding")).alias("embedding_dimension"),
            F.count_distinct(F.coalesce(F.col("source_file"), F.lit("unknown"))).alias("unique_sources"),
            F.min("year_range").alias("first_year_range"),
            F.max("year_range").alias("last_year_range"),
        )
        size = folder_size(self.spark, self._folder(name))
        return totals.withColumns(
            {"collection_name": F.lit(name), "size_mb": size.select("size_mb").scalar()}
        )

    def save_statistics(self, name: str) -> None:
        stamped = self.statistics(name).withColumn("creation_date", F.current_timestamp().cast("string"))
        stamped.coalesce(1).write.mode("overwrite").json(f"{self.root}/_statistics/{name}")


def _read(spark: SparkSession, stream: Any) -> str:
    lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    line = lines.readLine()
    lines.close()
    return "" if line is None else f"{line}\n" if line.endswith("}") else line


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_block", F.floor(F.col("row_no") / BLOCK_ROWS).cast("int"))


def _merged(stored: str | None, schema: T.StructType) -> str:
    """The stored fields plus new ones; a field keeps its type."""
    fields = {f["name"]: f for f in json.loads(stored)["fields"]} if stored else {}
    for f in json.loads(schema.json())["fields"]:
        known = fields.setdefault(f["name"], f | {"nullable": True})
        if known["type"] != f["type"]:
            raise ValueError(f"{f['name']} is stored as {known['type']}, not {f['type']}")
    return json.dumps({"type": "struct", "fields": list(fields.values())})


def total_size(files: DataFrame) -> DataFrame:
    """``(n_files, size_mb)`` of ``(path, length)`` rows."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.bround(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 2).alias("size_mb")
    )


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Size of everything below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return total_size(files.select("path", "length"))
