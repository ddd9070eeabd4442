"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: Python workers give large blocks back to the system at once, so that an idle worker keeps little.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (local mode, in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="crawlframe-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def settle(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for held in getattr(_open, "scratch", []):
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_open = threading.local()


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that `settle` writes inside the block, by this thread; `drop` deletes them when nothing reads them any more."""
    held: list[str] = []
    _open.scratch = [*getattr(_open, "scratch", []), held]
    try:
        yield held
    finally:
        _open.scratch = [x for x in _open.scratch if x is not held]


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def show_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package wherever the driver was started; a cluster gets it by --py-files."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        held.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts are long; a batch of the default size takes much memory
    if root not in held.get("PYTHONPATH", "").split(":"):
        held["PYTHONPATH"] = ":".join(filter(None, [root, held.get("PYTHONPATH", "")]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    show_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(name: str, taken: Iterable[str]) -> str:
    """name, or with underscores before it until no column is called so; names that differ in case only clash too."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about `most` bytes of text; a longer text is a run of its own or ends one."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) if len(texts) else np.zeros(0, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(lengths // most)) + 1 if len(lengths) else []
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if b > a:
            yield int(a), int(b)
