"""What the operators of this subpackage share: written tables, Arrow slices, components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker takes from an Arrow batch at a time.
SLICE_BYTES = 4 << 20
#: And rows.
SLICE_ROWS = 8192


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode a folder of this session if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, *by: str) -> DataFrame:
    """df, written as Parquet to the shared folder (in folders by these columns) and read again:
    its lineage ends there, and the loss of executors costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of written() tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for path in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in table.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about SLICE_BYTES of text, at least one row
    and at most SLICE_ROWS each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
        ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            to = min(to, at + SLICE_ROWS, len(texts))
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def blobs(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a 2-D uint8 array."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def byte_size(value: str) -> int:
    """Bytes of a Spark setting such as 4m, 64MB or 1048576; -1 where it can't be read."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", str(value).lower())
    return int(m[1]) << (10 * " kmgtp".index(m[2] or " ")) if m else -1


def narrow(df: DataFrame) -> DataFrame:
    """df, after bounding the Arrow batches of its session by bytes: a batch of long texts takes
    several times its size on both sides of the worker's pipe.  A smaller bound stays."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    if not 0 < byte_size(df.sparkSession.conf.get(key, "64m")) <= most:
        df.sparkSession.conf.set(key, f"{most}b")
    return df


#: What this worker keeps between tasks: tables of one operator at a time.
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """The worker's table of this key, made once; key[0] names the operator that keeps it."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _give_back(keeps: str | None) -> None:
    """Other operators' tables go, and freed memory returns to the system: Spark hands a worker
    from task to task, and what one had at its peak would stay with the next."""
    for key in [k for k in _held if k[0] != keeps]:
        del _held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run, schema, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded batches, by workers that give back their memory;
    `keeps` names the operator whose held tables stay from task to task."""

    def task(batches):
        _give_back(keeps)
        try:
            yield from run(batches)
        finally:
            _give_back(keeps)

    return narrow(df).mapInArrow(task, schema)


def column(df: DataFrame, name: str) -> str:
    """The name, as df writes it, of its column of this name in any case."""
    return next((c for c in df.columns if c == name), None) or next((c for c in df.columns if c.lower() == name.lower()), name)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names, so that no further
    column of the input can clash: named(df, doc_id="id", text="body")."""
    by = {name.lower(): name for name in narrow(df).columns}
    return df.select(*[F.col(f"`{by.get(old.lower(), old)}`").alias(new) for new, old in columns.items()])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component, low): of the nodes(id, low) that each of them reaches over links(a, b),
    the least low, ties to the least id, and that node's id.

    Labels fall to the least label next door and then jump to their label's label; each
    round is written to the shared folder, and no link or label comes to the driver.  The
    table of a round goes when the next one is written.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = nodes.select("id", F.struct("low", "id").alias("c"))
    least = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
    labels = written(labels.join(least, "id", "left").select("id", F.least("c", F.coalesce("near", "c")).alias("c")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "c"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("c").alias("near"))
        )
        met = labels.join(near, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("near", "c")).alias("c"))
        up = labels.select(F.col("id").alias("up"), F.col("c").alias("root"))
        after = written(met.join(up, F.col("c.id") == F.col("up"), "left").select("id", "old", F.least("c", F.coalesce("root", "c")).alias("c")))
        dropped(labels)
        labels = after
        if after.where("c <> old").isEmpty():
            dropped(both)
            return after.select("id", F.col("c.id").alias("component"), F.col("c.low").alias("low"))
