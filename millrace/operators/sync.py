"""Incremental synchronisation of sources: state, change feed, apply.

The truth about what is stored lives in the sink itself. A change feed is one full outer join of
sources with the sink's state; applying it writes new files for the touched buckets next to the old ones and
then a small numbered manifest, so a reader sees the old table or the new one and a crash leaves the old.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import token_of
from ..plans.tables import write_table


def source_state(rows: DataFrame) -> DataFrame:
    """``source_id, source_hash, content_hash`` of a sink; the hashes only where all of a source's rows agree."""
    pair = F.struct(F.coalesce("source_hash", F.lit("")).alias("s"), F.coalesce("content_hash", F.lit("")).alias("c"))
    found = rows.groupBy("source_id").agg(F.min(pair).alias("low"), F.max(pair).alias("high"))
    same = F.col("low") == F.col("high")
    return found.select("source_id", F.when(same, token_of(F.col("low.s"))).alias("source_hash"), F.when(same, token_of(F.col("low.c"))).alias("content_hash"))


def change_feed(sources: DataFrame, state: DataFrame, delete_orphans: bool = True) -> DataFrame:
    """``source_id, status``: add, update, skip or delete. ``sources`` has ``source_id, token``; a missing
    stored token always counts as changed. Nothing of the sources but id and token is shuffled."""
    stored = state.select("source_id", F.col("token").alias("old"), F.lit(True).alias("known"))
    both = sources.select("source_id", "token", F.lit(True).alias("live")).join(stored, "source_id", "full_outer")
    status = F.when(F.col("live").isNull(), "delete").when(F.col("known").isNull(), "add").when(token_of(F.col("old")) == F.col("token"), "skip").otherwise("update")
    feed = both.select("source_id", status.alias("status"))
    return feed if delete_orphans else feed.where("status <> 'delete'")


def repeated_sources(sources: DataFrame) -> DataFrame:
    """Source ids that come more than once: an error before anything is compared."""
    return sources.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")


def end_state(stored: DataFrame, feed: DataFrame, produced: DataFrame) -> DataFrame:
    """The sink after a change feed: rows of skipped and unknown sources stay, changed ones are replaced; a
    changed source that produced nothing is gone."""
    gone = feed.where("status in ('update', 'delete', 'add')").select("source_id")
    changed = feed.where("status in ('add', 'update')").select("source_id")
    return stored.join(gone, "source_id", "left_anti").unionByName(produced.join(changed, "source_id", "left_semi"))


class Conflict(RuntimeError):
    """Another writer committed first; read again and apply the change to what is there now."""


class VersionedTable:
    """A Parquet table in buckets of its key under one folder. Numbered manifests name each bucket's files;
    the highest number is the current version.

    A commit creates the next number's manifest and fails with ``Conflict`` if that exists: of two writers that
    began from one version, the second doesn't overwrite the first. Manifests are moved into place whole, which
    asks for a file system whose rename is atomic and refuses an existing target. Buckets that a
    change doesn't touch keep their files.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "source_id", buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str) -> list[str]:
        at = self._path(folder)
        return sorted(n for s in self._fs.listStatus(at) if (n := s.getPath().getName()).startswith(prefix)) if self._fs.exists(at) else []

    def _manifest(self) -> dict:
        found = self._names(self.folder, "manifest-")
        return json.loads(self.spark.read.text(f"{self.folder}/{found[-1]}").first()[0]) if found else {"version": 0, "schema": None, "buckets": {}}

    def version(self) -> int:
        """0 for a table that was never written."""
        return self._manifest()["version"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, schema: str | None = None, only: set[int] | None = None) -> DataFrame:
        """The current version, or only the named buckets of it."""
        now = self._manifest()
        if not now["version"] and schema is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        kind = StructType.fromJson(now["schema"]) if now["schema"] else schema
        paths = [f"{self.folder}/{at}" for b, at in sorted(now["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def stage(self, rows: DataFrame) -> dict[str, str]:
        """Write the rows as bucket folders that nobody reads yet; returns where each bucket is."""
        name = f"d-{uuid.uuid4().hex}"
        # Rebalancing by bucket cuts a bucket that holds much of the table into several files.
        marked = rows.withColumn("__bucket", self.bucket()).hint("rebalance", "__bucket")
        marked.write.partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        return {n.partition("=")[2]: f"{name}/{n}" for n in self._names(f"{self.folder}/{name}", "__bucket=")}

    def commit(self, staged: dict[str, str], schema: StructType, touched: set[int] | None = None, expected: int | None = None) -> int:
        """Make staged buckets the current ones in place of the touched (None: all); ``expected`` is the version that the
        change was made from (None: whatever is current)."""
        now = self._manifest()
        if expected is not None and expected != now["version"]:
            raise Conflict(f"version {now['version']} is current, the change was made from {expected}")
        kept = {} if touched is None else {b: at for b, at in now["buckets"].items() if int(b) not in touched}
        made = {"version": now["version"] + 1, "schema": schema.jsonValue(), "buckets": kept | staged}
        draft = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(draft, self._path(f"{self.folder}/manifest-{made['version']:012d}"), options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {made['version']} was committed by another writer") from e
            raise
        return made["version"]

    def replace(self, rows: DataFrame, touched: set[int] | None = None, expected: int | None = None) -> int:
        return self.commit(self.stage(rows), rows.schema, touched, expected)

    def vacuum(self) -> int:
        """Delete bucket folders that the current version doesn't name, and older manifests; returns how many folders."""
        live, n = set(self._manifest()["buckets"].values()), 0
        for name in self._names(self.folder, "d-"):
            inner = self._names(f"{self.folder}/{name}", "__bucket=")
            for b in inner:
                if f"{name}/{b}" not in live:
                    self._fs.delete(self._path(f"{self.folder}/{name}/{b}"), True)
                    n += 1
            if not any(f"{name}/{b}" in live for b in inner):
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        for name in self._names(self.folder, "manifest-")[:-1]:
            self._fs.delete(self._path(f"{self.folder}/{name}"), False)
        return n

    def delete_keys(self, keys: DataFrame) -> int:
        """Delete the rows of the keys (a table with the key column) in the buckets that they fall into."""
        expected = self.version()
        touched = {r[0] for r in keys.select(self.bucket()).distinct().collect()}  # no more rows than buckets
        if not touched or not expected:
            return expected
        return self.replace(self.read(only=touched).join(keys.select(self.key), self.key, "left_anti"), touched, expected)


def sync(table: VersionedTable, sources: DataFrame, produce, schema: str, delete_orphans: bool = True) -> DataFrame:
    """Compare, produce the changed sources' rows only, and rewrite the buckets that they fall into. ``produce``:
    sources → sink rows with ``source_id``. Returns the change feed. ``Conflict`` if another writer was faster."""
    expected = table.version()
    stored = table.read(schema)
    state = source_state(stored).withColumn("token", F.col("source_hash"))
    feed, _ = write_table(change_feed(sources, state, delete_orphans), "feed")
    todo = feed.where("status <> 'skip'")
    touched = {r[0] for r in todo.select(table.bucket()).distinct().collect()}  # no more rows than buckets
    if touched or not expected:
        changed = sources.join(todo.where("status <> 'delete'").select("source_id"), "source_id", "left_semi")
        old = table.read(schema, touched)
        table.replace(end_state(old, feed, produce(changed)).select(*old.columns), touched, expected)
    return feed
