"""What the operators share: tables, shared storage, bounded samples and
vectorised work on Arrow text buffers.

Text work never makes a Python object per word: an Arrow column is read as one
byte buffer with offsets, words are found with a byte table, and every word (or
run of words) gets a 64-bit hash from prefix sums.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text worked on at once in a Python worker; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or (tests) a temp folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            return


#: Spark's setting to delete a query's shuffle files when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The query's shuffle files go as soon as all is written; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shardloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._shardloom_path = path
    return back


def drop(*stored: DataFrame) -> None:
    """Delete what materialize() wrote for these frames; nothing may read them, or frames made from them, any more."""
    for df in stored:
        _delete(df.sparkSession, df._shardloom_path)
        _written.remove((df.sparkSession, df._shardloom_path))


def replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """materialize(new), then drop(old)."""
    stored = materialize(new)
    drop(old)
    return stored


def release(spark: SparkSession) -> None:
    """Let go of plans and shuffle files whose result has been written: both go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- expressions


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learnable(doc_id: str, modulus: int, remainder: int) -> Column:
    """Rows a model may learn from; a null id belongs to no fold, so it is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus != remainder, F.lit(False))


def sample_by_class(df: DataFrame, label: str, per_class: int, by: str) -> DataFrame:
    """About `per_class` rows of each label with different values of `by`, at most 1.25 times as many of each.

    The documented bound on what a classifier is fitted on. Every label is
    learned. Values are chosen by a hash of column `by`, so the sample doesn't
    depend on partitioning, and copies of a value count once in each label.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.col(by), F.lit(11)))
    counts = hashed.select(label, "_h").distinct().groupBy(label).agg(F.count("*").alias("_n"))
    draw = F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)
    picked = hashed.join(F.broadcast(counts), label).where(draw < per_class / F.col("_n"))
    once = picked.groupBy(label, "_h").agg(*[F.first(c).alias(c) for c in df.columns if c != label])
    order = Window.partitionBy(label).orderBy(draw, "_h")
    return once.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= int(1.25 * per_class)).select(*df.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, remainder: int) -> list:
    """At most 2.5 * `per_class` rows (text, _y) outside the held-out fold.

    Ids are drawn from the labels first, so no text is shuffled; the drawn ids
    are bounded by `per_class` and so may be broadcast. Labels other than 0 and
    1 are passed over; an id labelled twice counts as 1 if either is.
    """
    known = labels.where(F.col(label).isin(0, 1) & learnable("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max(label).alias("_y"))
    drawn = sample_by_class(known, "_y", per_class, "doc_id")
    most = int(2.5 * per_class)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "_y").orderBy(F.xxhash64("text"), "text").limit(most).collect()


# ---------------------------------------------------------------- bytes and words

_BYTES = np.arange(256)
#: ASCII upper case to lower case.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all beyond ASCII
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _power[k] = np.cumprod(p, dtype=np.uint64)
    return _power[0][:n], _power[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Prefix sums from which any byte span's hash follows in constant time."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in `data`, and for each document the index of its first word (n + 1 entries)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)  # a document starts here
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(data) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(start, offsets)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most CHUNK_BYTES of text each: (rows, bytes, offsets). A null text is empty."""
    limit = limit or CHUNK_BYTES
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema], schema=schema)


def texts_of(rows: list, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Driver-side counterpart of chunks() for a bounded sample."""
    parts = [(r[column] or "").encode() for r in rows]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets
