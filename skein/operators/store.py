"""Versioned, idempotent tables: what databases do with constraints, done with windows, joins and rewrites.

Functions take the table and the rows to write and return the new content; Table.replace() swaps it in. Keys are compared with
null-safe equality where a key may be null."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in the given order; ties must be broken by it."""
    ranks = W.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    return rows.withColumn("skein_rank", F.row_number().over(ranks)).where("skein_rank = 1").drop("skein_rank")


def numbered(rows: DataFrame, by: str, order: str, out: str = "idx", width: int = 100_000) -> DataFrame:
    """rows with their place, from 1, in the order of an integer column within each value of `by` (null is a value).

    Rows are numbered inside ranges of `width` values, and ranges by sums of their counts, so that a value with very many rows
    is spread over its ranges; rows that repeat `order` get places in any order."""
    keyed = rows.withColumn("skein_by", F.coalesce(F.concat(F.lit("s"), F.col(by).cast("string")), F.lit("n"))).withColumn("skein_range", F.floor(F.col(order) / width))
    counts = keyed.groupBy("skein_by", "skein_range").agg(F.count("*").alias("skein_n"))
    before = W.partitionBy("skein_by").orderBy("skein_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("skein_by", F.col("skein_range").alias("skein_at"), F.coalesce(F.sum("skein_n").over(before), F.lit(0)).alias("skein_before"))
    inside = F.row_number().over(W.partitionBy("skein_by", "skein_range").orderBy(order))
    placed = keyed.withColumn("skein_inside", inside).join(counts.withColumnRenamed("skein_by", "skein_own"), (F.col("skein_by") == F.col("skein_own")) & F.col("skein_range").eqNullSafe(F.col("skein_at")))
    return placed.withColumn(out, (F.col("skein_before") + F.col("skein_inside")).cast("int")).select(*rows.columns, out)


def first_of_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranks = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("skein_rank", F.row_number().over(ranks)).where("skein_rank = 1").drop("skein_rank")


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of `new` that are inserted: the first of each key that the table lacks."""
    return first_of_key(new, keys, order).join(table.select(*keys).distinct(), list(keys), "left_anti")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table with whole rows of `new` written over rows of one key; the last of `new` in `order` wins."""
    last = latest(new, keys, order).select(*table.columns)
    return table.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def merge_columns(table: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The table with only `columns` taken from `new` where the key is in both, and rows of `new` where it is not."""
    old, fresh = table.withColumn("skein_old", F.lit(True)).alias("o"), new.withColumn("skein_new", F.lit(True)).alias("n")
    both = old.join(fresh, list(keys), "full")
    taken = [(F.when(F.col("skein_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.when(F.col("skein_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in table.columns if c not in keys]
    return both.select(*keys, *taken)


def asof(targets: DataFrame, history: DataFrame, by: str, at: str, time: str, order: Sequence[str]) -> DataFrame:
    """Each target with the last history row of its key at or before it: targets' columns and `found`, a struct, or null.

    One sort of both sides per key and one running value; no join by range."""
    columns = history.columns
    left = targets.select("*", F.lit(None).cast(history.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("found"), F.col(by).alias("skein_key"), F.col(at).cast("long").alias("skein_time"), F.lit(1).alias("skein_side"), *[F.lit(None).cast(history.schema[c].dataType).alias(f"skein_{c}") for c in order])
    right = history.select(*[F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in targets.columns], F.struct(*columns).alias("found"), F.col(by).alias("skein_key"), F.col(time).cast("long").alias("skein_time"), F.lit(0).alias("skein_side"), *[F.col(c).alias(f"skein_{c}") for c in order])
    running = W.partitionBy("skein_key").orderBy("skein_time", "skein_side", *[f"skein_{c}" for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right).withColumn("found", F.last("found", ignorenulls=True).over(running))
    return both.where("skein_side = 1").select(*targets.columns, "found")


def unseen(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose identity has not been worked on."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def broken_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose parent is missing; Spark does not enforce foreign keys."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def unexpired(cache: DataFrame, now: Column | float, ttl: float) -> DataFrame:
    """Cache rows that may be read: the newest of each key (of equal times the greatest value), not older than ttl seconds (ttl <= 0:
    always). Table.replace() with these rows deletes the expired ones."""
    rows = latest(cache, ["key"], ["created_at", *[c for c in cache.columns if c not in ("key", "created_at")]])
    return rows if ttl <= 0 else rows.where((now if isinstance(now, Column) else F.lit(now)) - F.col("created_at") <= ttl)


def point_read(table: DataFrame, key: str, value: object, what: str = "row") -> dict:
    """The row of a key, or an error; the filter reaches the scan."""
    found = table.where(F.col(key).eqNullSafe(F.lit(value))).take(1)
    if not found:
        raise LookupError(f"{what} not found: {value}")
    return found[0].asDict(recursive=True)


class Conflict(RuntimeError):
    """Another writer has published a version first."""


class Log:
    """Numbered JSON documents in a folder. publish() shows a document whole or not at all, and only if its number is free: it is written
    under another name and then linked (one machine) or renamed without overwriting. What is no number or can't be read is no version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str = "") -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def numbers(self) -> list[int]:
        """All numbers that are taken, readable or not."""
        fs, where = self._at()
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(x) for x in names if x.isdigit())

    def read(self, number: int) -> dict | None:
        """A document, or None where it is damaged."""
        fs, where = self._at(f"{number:012d}")
        try:
            stream = fs.open(where)
            try:
                found = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None
        return found if isinstance(found, dict) else None

    def last(self, numbers: list[int] | None = None) -> tuple[int | None, dict]:
        """The last readable document and its number."""
        for number in reversed(self.numbers() if numbers is None else numbers):
            if (found := self.read(number)) is not None:
                return number, found
        return None, {}

    def publish(self, number: int, document: dict) -> None:
        name = f".{uuid.uuid4().hex}"
        fs, temporary = self._at(name)
        _, target = self._at(f"{number:012d}")
        stream = fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(document).encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace the other writer's file there
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm
                none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, target, none)
        except (FileExistsError, Py4JJavaError) as refusal:
            if number in self.numbers():
                raise Conflict(f"{self.path}: version {number} exists") from refusal
            raise
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)

    def delete(self, number: int) -> None:
        fs, where = self._at(f"{number:012d}")
        fs.delete(where, False)


class Tables:
    """Parquet tables of one folder that change together. A version is one document that lists the folders of every table, so a commit
    over several tables is seen whole or not at all.

    commit() writes the data first and publishes last: a writer that dies before that leaves folders that nothing names, which
    vacuum() deletes once they are old. Two writers that start from one version: the second finds its number taken, looks at
    what came between and publishes on top of it, if that touched none of the tables that it replaces or has read; else it gets a
    Conflict, and nothing of it is seen. Tables with a partition column keep one entry a partition, so that replace_in() swaps the
    partitions that hold some keys and leaves the others' files alone."""

    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, partitions: dict[str, str] | None = None):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions or {}
        self.log = Log(spark, f"{self.path}/commits")

    def versions(self) -> list[int]:
        return [n for n in self.log.numbers() if self.log.read(n) is not None]

    def version(self) -> int | None:
        return self.log.last()[0]

    def state(self, version: int | None = None) -> dict[str, dict]:
        """The entries (folders or their partitions) and the schema of each table at a version, the last one if none is named."""
        found = self.log.last()[1] if version is None else self.log.read(version)
        if found is None:
            raise LookupError(f"{self.path}: no version {version}")
        return found.get("tables", {})

    def batch(self, stream: str) -> int:
        """The number of a stream's last published batch, -1 before the first."""
        return self.log.last()[1].get("batches", {}).get(stream, -1)

    def has(self, name: str, version: int | None = None) -> bool:
        return name in self.state(version)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.state(version).get(name)
        if held is None:
            raise LookupError(f"{self.path}: no table {name}")
        schema = T.StructType.fromJson(held["schema"])
        if not held["entries"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.add("data", "string")).option("basePath", f"{self.path}/{name}")
        return rows.parquet(*[f"{self.path}/{name}/{x}" for x in held["entries"]]).select(*[F.col(f"`{c}`") for c in schema.fieldNames() if c != "data"])

    def get(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one of this schema (DDL) where there is none yet."""
        return self.read(name) if self.has(name) else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame) -> dict:
        """Writes a new folder of a table and returns its entries (the folder, or each of its partitions that hold rows) and schema."""
        schema, folder, by = json.loads(rows.schema.json()), f"data={uuid.uuid4().hex}", self.partitions.get(name)
        (rows.write.partitionBy(by) if by else rows.write).parquet(f"{self.path}/{name}/{folder}")
        if not by:
            return {"entries": [folder], "schema": schema}
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{folder}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory())
        return {"entries": [f"{folder}/{x}" for x in found], "schema": schema}

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, swap: dict[str, DataFrame] | None = None, reads: Sequence[str] = (), at: int | None = None, parts: Sequence[object] = (), batch: tuple[str, int] | None = None) -> int:
        """Writes all of these and publishes them as one version, which it returns.

        append adds rows, replace writes tables anew, swap (tables with a partition column) replaces the partitions that its rows fall in, and those
        of `parts`, which may be left without rows. reads: tables that the rows were made of. at: the version they were made of, the last one if
        it is not named. batch: a stream's name and the number of its batch; batches come in order, and one that is published already is not
        published again (the version is then the last one)."""
        base = self.version() if at is None else at
        if batch is not None and self.batch(batch[0]) >= batch[1]:
            return self.version()
        added = {name: self._write(name, rows) for name, rows in (append or {}).items()}
        anew = {name: self._write(name, rows) for name, rows in (replace or {}).items()}
        swapped = {name: self._write(name, rows) for name, rows in (swap or {}).items()}
        mine = {*anew, *swapped, *reads}
        before = self.state(base) if base is not None else {}
        for _ in range(self.TRIES):
            numbers = self.log.numbers()
            _, document = self.log.last(numbers)
            now, batches = dict(document.get("tables", {})), dict(document.get("batches", {}))
            if batch is not None:
                if batches.get(batch[0], -1) >= batch[1]:  # another run of the stream was faster
                    return max(numbers)
                batches[batch[0]] = batch[1]
            if moved := sorted(name for name in mine if now.get(name) != before.get(name)):
                raise Conflict(f"{self.path}: {', '.join(moved)} changed since version {base}")
            for name, new in anew.items():
                now[name] = new
            for name, new in (added | swapped).items():
                held = now.get(name, {"entries": [], "schema": new["schema"]})
                touched = {x.rpartition("/")[2] for x in new["entries"]} | {f"{self.partitions[name]}={x}" for x in parts} if name in swapped else set()
                names = {x["name"] for x in held["schema"]["fields"]}
                fields = held["schema"]["fields"] + [x | {"nullable": True} for x in new["schema"]["fields"] if x["name"] not in names]
                now[name] = {"entries": [x for x in held["entries"] if x.rpartition("/")[2] not in touched] + new["entries"], "schema": held["schema"] | {"fields": fields}}
            number = max(numbers, default=0) + 1
            try:
                self.log.publish(number, {"tables": now} | ({"batches": batches} if batches else {}))
                return number
            except Conflict:
                continue
        raise Conflict(f"{self.path}: other writers were faster {self.TRIES} times")

    def vacuum(self, keep: int = 1, older: float = 86_400.0) -> list[str]:
        """Deletes versions before the last `keep`, the folders that only they name, and folders that no version names and that
        are `older` seconds or more, which writers have left that died."""
        versions = self.versions()
        named = lambda v: {f"{name}/{x.partition('/')[0]}" for name, held in self.state(v).items() for x in held["entries"]}
        held = set().union(*[named(v) for v in versions[-keep:]]) if versions else set()
        old = set().union(*[named(v) for v in versions[:-keep]]) - held if versions[:-keep] else set()
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for table in fs.listStatus(where) if fs.exists(where) else []:
            if table.isDirectory() and table.getPath().getName() != "commits":
                for x in fs.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{x.getPath().getName()}"
                    if x.getPath().getName().startswith("data=") and name not in held and time.time() - x.getModificationTime() / 1000 >= older:
                        old.add(name)
        for name in sorted(old):
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        for v in versions[:-keep]:
            self.log.delete(v)
        return sorted(old)


class Table:
    """One table with versions of its own: Tables of which one is used."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.tables = Tables(spark, path, {"rows": partition} if partition else None)

    def versions(self) -> list[int]:
        return self.tables.versions()

    def version(self) -> int | None:
        return self.tables.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self.tables.read("rows", version)

    def append(self, rows: DataFrame) -> None:
        self.tables.commit(append={"rows": rows})

    def replace(self, rows: DataFrame) -> None:
        self.tables.commit(replace={"rows": rows})

    def vacuum(self, keep: int = 1) -> list[str]:
        return [x.partition("/")[2] for x in self.tables.vacuum(keep)]
