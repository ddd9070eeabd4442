"""Append-only datasets of JSON items, key-value stores and queue files, as tables and as files."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import request_id
from ..functions.text import extension, valid_component
from ..plans.crawl import Waves


def append(items: DataFrame, path: str, dataset: str, order: list[str], start: int | None = None) -> None:
    """Append items (a column `item` of JSON text) to a dataset, numbered on from its last. Numbers follow `order`.

    Numbers are given within sorted ranges and offset by the ranges' sizes, so no task orders all items.
    """
    spark = items.sparkSession
    if start is None:
        try:
            start = spark.read.parquet(path).filter(F.col("dataset") == dataset).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        except Exception as e:  # no dataset yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            start = 0
    numbered(items, order).select(F.lit(dataset).alias("dataset"), (F.col("seq") + start).alias("seq"), "item").write.mode("append").parquet(path)


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """items with seq, from 1 on in `order`: ranges are numbered each, then moved by the rows of the ranges before.

    The ranges are written once, so that a task run again after a loss finds the same ones.
    """
    cut = Waves(items.sparkSession, "numbered").add(items.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), 0)
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_n", own).join(before, F.col("_part") == F.col("_p")).withColumn("seq", (F.col("_n") + F.col("_before")).cast("long")).drop("_part", "_p", "_n", "_before")


def page(items: DataFrame, offset: int = 0, limit: int | None = None, desc: bool = False) -> tuple[DataFrame, int]:
    """One page of a dataset by seq, and the number of all items."""
    out = items.orderBy(F.desc("seq") if desc else F.asc("seq")).offset(offset)
    return (out if limit is None else out.limit(limit)), items.count()


def info(items: DataFrame, name: str, at: str) -> DataFrame:
    """name, items, created and modified of a dataset."""
    return items.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("items"), F.min(at).alias("created"), F.max(at).alias("modified"))


def typed(items: DataFrame, schema: str) -> DataFrame:
    """The items as columns; one that doesn't parse fails the read."""
    return items.select("seq", F.from_json("item", schema, {"mode": "FAILFAST"}).alias("_r")).select("seq", "_r.*")


def keys(items: DataFrame) -> DataFrame:
    """Sorted union of the items' object keys, one row each."""
    return items.select(F.explode(F.json_object_keys("item")).alias("key")).distinct()


def csv_rows(items: DataFrame, header: list[str] | None = None) -> tuple[str, DataFrame]:
    """Header line, and (seq, line) of the items: a column for each key, missing ones empty, strings raw, others as JSON."""
    header = sorted(r.key for r in keys(items).collect()) if header is None else header
    bad = items.filter(~F.coalesce(F.json_object_keys("item").isNotNull(), F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("only objects can be written as CSV")
    value = lambda k: F.try_variant_get(F.parse_json("item"), f'$["{k}"]', "variant")

    def cell(k: str) -> Column:
        v = value(k)
        text = F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))
        return F.coalesce(csv_quote(text), F.lit(""))

    line = F.concat_ws(",", *[cell(k) for k in header]) if header else F.lit("")
    return ",".join(_quote(k) for k in header), items.select("seq", line.alias("line"))


def _quote(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s


def csv_quote(text: Column) -> Column:
    """A field in quotes, doubled inside, where it needs them."""
    return F.when(text.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


@contextmanager
def atomic(path: str, **how) -> Iterator[IO]:
    """A file that appears under its name only when it is whole: written beside it under a temporary name, then renamed."""
    folder, name = os.path.split(path)
    temporary = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.tmp")
    try:
        with open(temporary, "w", **how) as f:
            yield f
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


def is_temporary(name: Column) -> Column:
    """Whether a file's name is one of `atomic`'s that a broken write left."""
    return name.rlike(r"^\..*\.[0-9a-f]{32}\.tmp$")


def export_csv(items: DataFrame, path: str) -> None:
    """One CSV file: rows end in CR LF but the last. Rows are streamed through the driver a partition at a time."""
    header, rows = csv_rows(items)
    with atomic(path, newline="", encoding="utf-8") as f:
        f.write(header)
        for r in rows.orderBy("seq").toLocalIterator():
            f.write("\r\n" + r.line)


def export_json(items: DataFrame, path: str) -> None:
    """One JSON array, an item a line."""
    with atomic(path, encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(items.orderBy("seq").toLocalIterator()):
            f.write(("," if i else "") + "\n  " + r.item)
        f.write("\n]" if items.limit(1).count() else "]")


def kv_set(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """A store after new entries: the last version of each key stays."""
    both = old.unionByName(new)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(version)))).filter("_n = 1").drop("_n")


def kv_get(store: DataFrame, key: str) -> DataFrame:
    return store.filter(F.col("key") == key)


def kv_delete(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.join(gone.select("key").distinct(), "key", "left_anti")


def kv_json(store: DataFrame, value: Column) -> DataFrame:
    """store with a typed value as JSON text of media type application/json."""
    return store.withColumn("value", F.to_json(value)).withColumn("content_type", F.lit("application/json"))


def kv_typed(store: DataFrame, schema: str) -> DataFrame:
    """key and the JSON value's fields; a value that doesn't parse fails the read."""
    return store.select("key", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("key", "_r.*")


def purge(store: DataFrame, default: str = "default", keep: str = "INPUT") -> DataFrame:
    """What stays of key-value stores (store, key) when they are emptied: the default store's input, whatever its extension."""
    return store.filter((F.col("store") == default) & (F.split_part("key", F.lit("."), F.lit(1)) == keep))


def stream(items: DataFrame, offset: int = 0, limit: int | None = None, desc: bool = False) -> Iterator[str]:
    """The items of a page one by one, a partition in memory at a time."""
    return (r.item for r in page(items, offset, limit, desc)[0].select("item").toLocalIterator(prefetchPartitions=False))


def read_bodies(spark: SparkSession, folder: str, chunk: int = 1 << 20) -> DataFrame:
    """path, position and bytes of the files of a folder, cut into chunks, as a streamed body gives them; an empty file gives none."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("long")))
    return files.withColumn("position", at).select("path", "position", F.substring("content", (F.col("position") + 1).cast("int"), F.lit(chunk)).alias("bytes"))


class State:
    """One typed row that outlives its session: opened from the shared folder, or with a default; set, changed and persisted.

    Each version is a folder of its own, so that a write that breaks leaves the last whole one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, default: tuple):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.version = self._last()
        self.value = default if self.version is None else tuple(spark.read.schema(schema).parquet(f"{self.path}/version={self.version}").first())

    def _last(self) -> int | None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        whole = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(whole, default=None)

    def get(self) -> tuple:
        return self.value

    def set(self, value: tuple) -> None:
        self.value = value

    def update(self, change: Callable[[tuple], tuple]) -> tuple:
        self.value = change(self.value)
        return self.value

    def persist(self) -> None:
        version = 0 if self.version is None else self.version + 1
        self.frame().coalesce(1).write.parquet(f"{self.path}/version={version}")
        self.version = version

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([self.value], self.schema)


class Storage:
    """Datasets, key-value stores and states by name, as tables under one folder; `default` is the name without one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, name: str | None) -> str:
        name = "default" if name is None else name
        if not name or re.search(r"[/\\\x00]|\.\.", name):
            raise ValueError(f"{name!r} can't be the name of a store")
        return f"{self.root}/{kind}/{name}"

    def push(self, items: DataFrame, order: list[str], name: str | None = None) -> None:
        append(items, self.path("datasets", name), name or "default", order)

    def dataset(self, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path("datasets", name))

    def state(self, schema: str, default: tuple, name: str | None = None) -> State:
        return State(self.spark, self.path("states", name), schema, default)


def list_keys(store: DataFrame, after: str | None = None, limit: int = 1000) -> tuple[DataFrame, bool]:
    """key and size of the first `limit` keys after one, in order, and whether there are more."""
    rows = store if after is None else store.filter(F.col("key") > after)
    rows = rows.select("key", "size").orderBy("key")
    return rows.limit(limit), limit > 0 and rows.limit(limit + 1).count() > limit


def file_names(store: DataFrame) -> DataFrame:
    """store with the file name of each entry; names that can't be files raise."""
    good = F.assert_true(valid_component(F.col("key")), F.concat(F.lit("not a file name: "), F.col("key")))
    return store.withColumn("file", F.when(good.isNull(), F.concat("key", F.lit("."), extension(F.col("content_type")))))


def scan_items(spark: SparkSession, folder: str) -> DataFrame:
    """seq and item of a folder of numbered JSON files, nine digits each and above 0; unreadable items are left out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("seq", F.regexp_extract(F.input_file_name(), r"/(\d{9})\.json$", 1).try_cast("long"))
    return files.filter((F.col("seq") > 0) & F.try_parse_json("value").isNotNull()).select("seq", F.col("value").alias("item"))


def scan_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of a folder of JSON files in any of three shapes: an envelope with the request as text, the same in camel case with its fields outside, or the bare request.

    An envelope without order number is handled; a bare request is pending.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").filter(F.try_parse_json("value").isNotNull())
    get = lambda c, p, t="string": F.try_variant_get(F.try_parse_json(c), f"$.{p}", t)
    inner = get("value", "json")
    own = raw.withColumn("inner", F.coalesce(inner, F.lit("{}")))
    pick = lambda *options: F.coalesce(*options)
    bare = get("value", "unique_key").isNotNull() & inner.isNull()
    out = own.select(
        pick(get("value", "uniqueKey"), get("value", "unique_key"), get("inner", "unique_key")).alias("unique_key"), pick(get("value", "url"), get("inner", "url")).alias("url"),
        pick(get("value", "method"), get("inner", "method"), F.lit("GET")).alias("method"), pick(get("value", "label"), get("value", "userData.label"), get("inner", "label")).alias("label"),
        pick(get("value", "retryCount", "int"), get("value", "retry_count", "int"), get("inner", "retry_count", "int"), F.lit(0)).alias("retry_count"),
        get("value", "orderNo", "long").alias("order_no"), (get("value", "orderNo", "long").isNull() & ~bare).alias("handled"),
    )
    return out.filter("unique_key IS NOT NULL").withColumn("id", request_id(F.col("unique_key")))
