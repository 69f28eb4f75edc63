"""Small helpers that several operators share: shared-folder tables, Arrow slices and vectorised words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes (space, \t \n \v \f \r).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: Of small working tables.
ROWS_A_FILE = 20_000

_own_dir: str | None = None
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder, but only if executors run in the driver's machine."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


#: Rows of an Arrow batch where the session keeps Spark's default of 10,000.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Texts of 10,000 rows at once are held by Spark and by the worker, beside what is made of them. Lowers the default for the session; another setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_roots: list[str] = []


def _tidy() -> None:
    """At the end of the driver's process: deletes the tables that results were read from, if Spark still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for root in _roots:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the session may end first
        return


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.n = 0
        if not _roots:
            atexit.register(_tidy)
        _roots.append(self.root)

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many rows df has, if that is known. A small table then has few files, however many shuffle partitions there are."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_A_FILE)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files under tables that nothing reads any more."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        for df in tables:
            for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                if self.root.partition(":")[2].lstrip("/") in parent:
                    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice has about max_bytes of text and max_rows at most (one row at least): what is worked on at once is bounded
    by these and the longest text. What arrives at once is Spark's to bound: see small_batches, and spark.sql.execution.arrow.maxBytesPerBatch.

    At the end of a task the worker gives freed memory back, as it may wait idle beside the next tasks."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)) if len(col) else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + max_rows, int(np.searchsorted(ends, base + max_bytes, side="right"))))
            yield batch.slice(at, to - at)
            at = to
        del batch, col, ends
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        return


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each text (one more entry than texts). No word crosses texts."""
    space = _IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes, in place on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse. Kept for runs of SEGMENT bytes; a longer word gets its own."""
    if n <= SEGMENT + 1 and base in _POWERS:
        return _POWERS[base]
    size = max(n, SEGMENT + 1)
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    found = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == SEGMENT + 1:
        _POWERS[base] = found
    return found


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of each word's bytes: differences of a running polynomial, brought to a common power, then mixed. Worked on in runs of about SEGMENT bytes."""
    out, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        a = int(starts[k])
        to = max(k + 1, int(np.searchsorted(ends, a + SEGMENT, side="right")))
        run = data[a : int(ends[to - 1])]
        up, down = _powers(len(run) + 1, base)
        total = np.zeros(len(run) + 1, np.uint64)
        np.cumsum((run.astype(np.uint64) + np.uint64(1)) * up[: len(run)], out=total[1:])
        out[k:to] = mix((total[ends[k:to] - a] - total[starts[k:to] - a]) * down[starts[k:to] - a])
        k = to
    return out


def window_hashes(h: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of `length` consecutive entries of h (len(h) - length + 1 entries)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = h[:n].copy(), np.uint64(base)
    for k in range(1, length):
        out *= b
        out += h[k : k + n]
    return mix(out)


def frequent(counts: DataFrame, most: int) -> int:
    """counts(n): the least n of which at most `most` rows have as much or more."""
    step = F.floor(F.log2("n") * 16)  # a row for each sixteenth of an octave
    found = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), reverse=True)
    total, least = 0, 1 << 62
    for _, k, n in found:
        total += k
        if total > most:
            break
        least = n
    return least
