"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows are handed to the kernels in groups of about this many characters, so
#: that memory does not depend on how many rows Arrow puts into a batch.
SLICE_CHARS = 4_000_000
#: Characters of a block of texts that asks a table for its keys once, and of a part of it that is worked on at a time.
BLOCK_CHARS, PART_CHARS = 24_000_000, 1_000_000

#: Rows of one key that one task may get, and keys with more of them that may be broadcast.
SPLIT, BROADCAST_KEYS = 2000, 1_000_000

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it was not installed or shipped with ``--py-files``.

    Rows with whole texts are large: unless a user has chosen, Arrow batches get fewer of them.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see.

    Only where the setting is absent and the master is local, as in tests, is a
    temporary folder of this machine used instead.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.gettempdir(), f"stemma-{os.getuid()}").as_uri()
    if base.startswith("/"):  # a path of the default file system
        base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, to: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a plan that lost executors can't undo.

    The shuffle files of the job that wrote it are of no more use and go at its end.
    ``by``: columns whose values name the table's folders.
    """
    spark = df.sparkSession
    to = to or shared_dir(spark)
    schema = df.schema
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").partitionBy(*by).parquet(to)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(schema).parquet(to)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table in the shared folder that no plan reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one job in the shared folder, deleted by ``clear`` when its last one has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        self.folders.append(shared_dir(self.spark))
        return cut(df, self.folders[-1])

    def clear(self) -> None:
        while self.folders:
            discard(self.spark, self.folders.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(per_key: DataFrame, split: int = SPLIT) -> DataFrame | None:
    """The rows of ``per_key`` (key, n, ...) for keys with more than ``split`` rows, where there are some, few enough to be broadcast."""
    hot = per_key.filter(F.col("n") > split)
    n = hot.limit(BROADCAST_KEYS + 1).count()
    return hot if 0 < n <= BROADCAST_KEYS else None


def join_by(rows: DataFrame, per_key: DataFrame, key: str, split: int = SPLIT) -> DataFrame:
    """``rows`` joined with ``per_key``, which tells as ``n`` how many rows a key has: the frequent keys by broadcast."""
    hot = hot_keys(per_key, split)
    if hot is None:
        return rows.join(per_key, key)
    rest = rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti").join(per_key.filter(F.col("n") <= split), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def tidy() -> None:
    """Give memory that a task has freed back to the system, as workers live on beside the next tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[dict[str, list]]:
    """Columns as Python lists, in runs of rows whose texts have about ``chars`` bytes."""
    for batch in batches:
        names = batch.schema.names
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            held += n
            if held >= chars or i == len(sizes) - 1:
                yield {c: batch.column(c).slice(at, i + 1 - at).to_pylist() for c in names}
                at, held = i + 1, 0


def blocks_of(batches, text: str):
    """Runs of record batches with about ``BLOCK_CHARS`` bytes of text, in parts of ``PART_CHARS``."""
    held, chars = [], 0
    for b in batches:
        sizes = pc.binary_length(b.column(text)).fill_null(0).to_pylist()
        at = part = 0
        for i, n in enumerate(sizes):
            part += n
            if part >= PART_CHARS or i + 1 == len(sizes):
                held.append(b.slice(at, i + 1 - at))
                chars += part
                at, part = i + 1, 0
                if chars >= BLOCK_CHARS:
                    yield held
                    held, chars = [], 0
    if held:
        yield held


def packed(part: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_batch(part)
    return sink.getvalue()


def named_block(i: int) -> int:
    """The name of a task's block ``i``, from its partition: the same if the task runs again."""
    return TaskContext.get().partitionId() << 32 | i


def block_join(
    docs: DataFrame,
    table: DataFrame,
    text: str,
    wanted: Callable[[Iterable[list[str | None]]], object],
    key_type: pa.DataType,
    answered: Callable[[pa.Table], Callable[[pa.Table], pa.Table]],
    out: StructType,
) -> DataFrame:
    """Join texts with what ``table`` (key, ...) knows of them, without a row for each of their parts.

    Texts of a task form blocks.  ``wanted`` names a block's distinct keys from its
    texts; these meet ``table`` in an ordinary join, so that neither a large table
    nor a frequent key gathers anywhere.  What is found meets the block again, which
    travels compressed; ``answered`` makes from it the function that turns each part
    of the block into rows of ``out``, and must fail where an answer is missing.
    Blocks are named by partition and number, so that the two readings of ``docs``,
    and a task that runs again, name them alike: ``docs`` must read the same twice.
    """

    def asks(batches):
        for i, parts in enumerate(blocks_of(batches, text)):
            keys, name = wanted(p.column(text).to_pylist() for p in parts), named_block(i)
            for at in range(0, len(keys), 100_000):
                some = pa.array(keys[at : at + 100_000], key_type)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), some], names=["block", "key"])
        tidy()

    def packs(batches):
        for i, parts in enumerate(blocks_of(batches, text)):
            name = named_block(i)
            for p in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int64()), pa.array([packed(p)], pa.binary())], names=["block", "part"]
                )

    def done(left: pa.Table, right: pa.Table) -> pa.Table:
        apply = answered(right)
        found = [apply(pa.ipc.open_stream(raw.as_buffer()).read_all()) for raw in left.column("part")]
        tidy()
        return pa.concat_tables(found) if found else pa.table({f.name: [] for f in out})

    kind = "bigint" if pa.types.is_integer(key_type) else "string"
    answers = docs.mapInArrow(asks, f"block bigint, key {kind}").join(table, "key")
    blocks = docs.mapInArrow(packs, "block bigint, part binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(done, out).select(*out.names)
