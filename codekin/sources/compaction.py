"""Consolidating a store of many small files, one snapshot at a time.

A store is a folder. Every write goes to new folders ``data/batch=B/part=N/`` that no one else writes
to; ``snapshots/`` has one small JSON file per version, which lists the live folders: of each batch,
its live partitions. Readers see exactly the folders of one snapshot, so a write is visible once its
snapshot exists, whole or not at all, and nothing is removed before ``vacuum``.

A compaction

1. reads the newest snapshot,
2. counts the small files of each partition (in Spark, from file metadata alone),
3. rewrites only the partitions with too many of them, by dynamic partition overwrite into a batch of
   its own, as files of about the target size,
4. commits a snapshot with the new folders in place of those it read. Snapshot files are created
   exclusively. If another writer has committed in between, the change is applied to that writer's
   snapshot: what it added stays, and if it replaced a folder read here, the compaction stops with
   ``ConflictError`` and nothing has changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codekin.plans import scratch
from codekin.sources.tables import BLANKS

BATCH, PART = "batch", "part"
LEAST_PARTS = 8  # partitions of a small store
FILES_A_PART = 8  # well-sized files that a partition of a large store holds


class ConflictError(RuntimeError):
    """Another writer replaced what this change was made from."""


class Store:
    """A partitioned Parquet store with snapshot versions; works on any Hadoop file system whose
    rename refuses an existing target."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.data, self.snapshots = f"{self.path}/data", f"{self.path}/snapshots"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """The numbers of the snapshots, in order."""
        fs, p = self._fs(self.snapshots)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest snapshot's number; 0 for a store without one."""
        return max(self.versions(), default=0)

    def snapshot(self, version: int) -> dict:
        """version, operation, schema and ``live``: of each batch its live partitions and whether these
        are all it was written with."""
        if not version:
            return {"version": 0, "operation": "create", "schema": None, "live": {}}
        fs, p = self._fs(f"{self.snapshots}/{version:010d}.json")
        stream = fs.open(p)
        try:
            jvm = self.spark.sparkContext._jvm
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, body: dict) -> bool:
        """Write a snapshot under its number; False if the number is taken."""
        sc = self.spark.sparkContext
        jvm = sc._jvm
        fs, draft = self._fs(f"{self.snapshots}/.{uuid.uuid4().hex}.draft")
        _, final = self._fs(f"{self.snapshots}/{version:010d}.json")
        out = fs.create(draft, False)
        jvm.org.apache.commons.io.IOUtils.write(json.dumps(body), out, "UTF-8")
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), options)
            return True
        except Exception as e:  # noqa: BLE001
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise e

    def commit(self, operation: str, added: dict[str, list[int]], removed: dict[str, list[int]], schema: str, expected: int | None = None) -> int:
        """Create the next snapshot: the newest one without the folders ``removed`` and with ``added``.

        Raises ``ConflictError``, and changes nothing, if a folder to remove is no longer live, or if
        ``expected`` is given and is not the newest version."""
        while True:
            newest = self.version()
            if expected is not None and newest != expected:
                raise ConflictError(f"{self.path} is at version {newest}, not {expected}")
            live = self.snapshot(newest)["live"]
            for batch, parts in removed.items():
                entry = live.get(batch, {"parts": []})
                if set(parts) - set(entry["parts"]):
                    raise ConflictError(f"a snapshot up to {newest} of {self.path} has replaced partitions of this change")
                left = sorted(set(entry["parts"]) - set(parts))
                live.pop(batch)
                if left:
                    live[batch] = {"parts": left, "whole": False}
            live |= {batch: {"parts": sorted(parts), "whole": True} for batch, parts in added.items()}
            if self._create(newest + 1, {"version": newest + 1, "operation": operation, "schema": schema, "live": live}):
                return newest + 1

    def _written(self, df: DataFrame, batch: Column) -> dict[str, list[int]]:
        """Write rows to folders of their own and return these: of each batch its partitions.

        A folder's name starts with a fresh id, so no other writer's folders can be touched; a job
        that is run again overwrites its own."""
        own = uuid.uuid4().hex
        rows = df.withColumn(BATCH, F.concat(F.lit(f"{own}-"), F.coalesce(batch.cast("string"), F.lit("none"))))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, PART).parquet(self.data)
        fs, p = self._fs(f"{self.data}/{BATCH}={own}-*")
        folders = [s.getPath().toString() for s in fs.globStatus(p) or []]
        found = self._files(folders).groupBy(BATCH).agg(F.collect_set(PART).alias("parts")).collect() if folders else []
        return {r[BATCH]: sorted(r["parts"]) for r in found}

    def append(self, df: DataFrame, batch: Column | None = None, expected: int | None = None) -> int:
        """Add rows; ``df`` has the partition column ``part``. Rows of different ``batch`` go to different
        files. With ``expected`` the rows are added only if that is still the newest version; a refused
        append leaves no visible row."""
        added = self._written(df, F.lit("rows") if batch is None else batch)
        schema = T.StructType([f for f in df.schema.fields if f.name != PART] + [T.StructField(PART, T.IntegerType())])
        return self.commit("append", added, {}, schema.json(), expected)

    def _paths(self, live: dict, parts: set[int] | None = None) -> list[str]:
        out = []
        for batch, entry in sorted(live.items()):
            if entry["whole"] and parts is None:
                out.append(f"{self.data}/{BATCH}={batch}")
            else:
                out += [f"{self.data}/{BATCH}={batch}/{PART}={p}" for p in entry["parts"] if parts is None or p in parts]
        return out

    def _rows(self, snapshot: dict, parts: set[int] | None = None) -> DataFrame:
        if snapshot["schema"] is None:
            raise ValueError(f"{self.path} holds nothing yet")
        schema = T.StructType.fromJson(json.loads(snapshot["schema"]))
        paths = self._paths(snapshot["live"], parts)
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
        return self.spark.read.schema(whole).option("basePath", self.data).parquet(*paths).drop(BATCH)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one snapshot, the newest by default. The folders are fixed here: a later commit
        does not change what is read."""
        return self._rows(self.snapshot(self.version() if version is None else version))

    def _files(self, paths: list[str]) -> DataFrame:
        """batch, part and bytes of every data file; contents are not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths)
        name = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
        return files.select(name(BATCH).alias(BATCH), name(PART).cast("int").alias(PART), F.col("length").alias("bytes"))

    def file_counts(self, small_bytes: int, version: int | None = None) -> DataFrame:
        """part, files, small files and bytes of each partition, from file metadata."""
        paths = self._paths(self.snapshot(self.version() if version is None else version)["live"])
        empty = self.spark.createDataFrame([], "batch string, part int, bytes long")
        return (self._files(paths) if paths else empty).groupBy(PART).agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum((F.col("bytes") < small_bytes).cast("long")).alias("n_small"),
            F.sum("bytes").alias("bytes"),
        )

    def compact(self, target_bytes: int = 128 << 20, min_small_files: int = 2) -> tuple[int, list[int]]:
        """Rewrite the partitions that hold ``min_small_files`` or more files below half the target.

        Rows are only moved. Returns the new version and the partitions rewritten; without any there is
        no new snapshot. The list of partitions with small files is collected: it is bounded by the
        partitions of the store, one for ``FILES_A_PART`` files of the target size."""
        since = self.version()
        counts = self.file_counts(target_bytes // 2, since).where(F.col("n_small") >= min_small_files)
        todo = {r[PART]: r["bytes"] for r in counts.select(PART, "bytes").collect()}
        if not todo:
            return since, []
        before = self.snapshot(since)
        rows = self._rows(before, set(todo))
        # every output file is one task of its own: file ``first + hash % files`` of its partition
        slots, total = [], 0
        for p, size in sorted(todo.items()):
            files = max(1, -(-size // target_bytes))
            slots.append((p, total, files))
            total += files
        slot = self.spark.createDataFrame(slots, f"{PART} int, __first int, __files int")
        content = F.xxhash64(*[c for c in rows.columns if c != PART])
        rows = rows.join(slot, PART).withColumn("__slot", F.col("__first") + F.pmod(content, F.col("__files")).cast("int"))
        rows = rows.repartitionById(total, "__slot").drop("__first", "__files", "__slot")
        removed = {b: sorted(set(e["parts"]) & set(todo)) for b, e in before["live"].items() if set(e["parts"]) & set(todo)}
        added = self._written(rows, F.lit("compact"))
        return self.commit("compact", added, removed, before["schema"]), sorted(todo)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders and snapshots that only snapshots before the newest ``keep`` name; returns
        the number of folders deleted. Folders of writers that have not committed are left alone."""
        known = self.versions()
        kept = {(b, p) for v in known[-keep:] for b, e in self.snapshot(v)["live"].items() for p in e["parts"]}
        gone = {(b, p) for v in known[:-keep] for b, e in self.snapshot(v)["live"].items() for p in e["parts"]} - kept
        for batch, part in gone:
            fs, p = self._fs(f"{self.data}/{BATCH}={batch}/{PART}={part}")
            fs.delete(p, True)
        for v in known[:-keep]:
            fs, p = self._fs(f"{self.snapshots}/{v:010d}.json")
            fs.delete(p, False)
        return len(gone)


_ADDRESS = r"""(?i)(?:^|[^0-9a-z])(?:0x)?([0-9a-f]+)h?["'\s]*$"""


def graph_records(files: DataFrame) -> DataFrame:
    """The graph files that hold a record, with what makes records equal: file_id, ``addr``, ``body``.

    A null or blank title, a null body, or one whose last non-blank line is not a lone closing
    brace is no record. ``addr`` is the hexadecimal number at the end of the title without leading
    zeros, sign of base or case; a title without one stands for itself, trimmed. In the body, line
    ends become one line feed, white space at line ends and blank lines at the end are dropped.
    A null file_id is a value like any other. ``arrived`` is the quarter of arrival, null if unknown.
    """
    body = F.regexp_replace("body", r"\r\n?", "\n")
    body = F.regexp_replace(body, r"(?m)[ \t]+$", "")
    body = F.regexp_replace(body, r"\n+\z", "")
    number = F.lower(F.regexp_extract("title", _ADDRESS, 1))
    addr = F.when(number == "", F.btrim("title", F.lit(BLANKS))).otherwise(
        F.coalesce(F.expr("nullif(ltrim('0', __number), '')"), F.lit("0"))
    )
    return (
        files.where((F.btrim("title", F.lit(BLANKS)) != "") & F.col("body").isNotNull())
        .withColumn("__number", number)
        .select("gdl_id", "file_id", addr.alias("addr"), body.alias("body"), F.concat(F.year("written_at"), F.lit("q"), F.quarter("written_at")).alias("arrived"))
        .where(F.regexp_like("body", F.lit(r"(^|\n)[ \t]*\}\z")))
    )


def distinct_graphs(records: DataFrame) -> DataFrame:
    """``graph_records`` once each: with the smallest gdl_id (null only where there is no other) and the
    first quarter of arrival. Combined before the shuffle, so a group of copies costs one row a task."""
    return records.groupBy("file_id", "addr", "body").agg(F.min("gdl_id").alias("gdl_id"), F.min("arrived").alias("arrived"))


def compacted_graphs(files: DataFrame, target_bytes: int = 128 << 20, path: str | None = None) -> DataFrame:
    """Every graph of the tiny files ``files`` exactly once, from a store of few well-sized files.

    Copies go first, in the plan, whatever the sizes of files. The records land in the store by
    quarter of arrival, one file for each quarter and partition at most; then the partitions where that
    left several small files are compacted, and the others stay. A partition is a hash of the record,
    so neither a binary with very many graphs nor a group of copies makes one large. An empty input
    gives an empty result.
    """
    spark = files.sparkSession
    store = Store(spark, path or scratch.new_path(spark, "graphs"))
    volume = files.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-volume // (FILES_A_PART * target_bytes)))
    key = F.xxhash64("file_id", "addr", "body")
    landed = distinct_graphs(graph_records(files)).withColumn(PART, F.pmod(key, F.lit(parts)).cast("int"))
    tasks = max(parts, -(-volume // target_bytes))
    store.append(landed.repartition(tasks, "arrived", PART), F.col("arrived"))
    store.compact(target_bytes=target_bytes)
    return store.read()
