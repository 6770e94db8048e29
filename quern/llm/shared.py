"""What the corpus operators share: tables, the shared folder, batches and hashed words."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step holds at most, but for a single longer text.
SLICE_BYTES = 4 << 20
#: Bytes that a batch from Spark to Python holds, but for its last row: just under a slice, so that most batches are one slice.
BATCH_BYTES = SLICE_BYTES // 16 * 15
#: Bytes of text whose words are hashed at once, but for a single longer word.
HASH_BYTES = 1 << 18
#: Seconds between two sweeps of what earlier steps left on disk.
SWEEP_S = 5.0
_swept = [float("-inf")]
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where an installed public tokenizer's file is; the operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir; set here only where unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing.

    Shuffle files of earlier steps go first: Spark drops them when their plans are collected as garbage.
    Within SWEEP_S of the last time that waits for a later step, so that many short steps don't spend their time on it.
    """
    spark = df.sparkSession
    if time.monotonic() - _swept[0] > SWEEP_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes what saved() wrote for df; only for tables that no lazy result reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python end by bytes (BATCH_BYTES; set here only where unset), not by their 10,000 rows alone: JVM and worker each hold whole ones."""
    if not spark.conf.get(BATCH_LIMIT, None):
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str, text: str | None = None, size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow in slices: with ``text`` named, a slice has at most ``size`` bytes of it (or one row), so that memory is bounded by the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, size):
                made = step(part)
                yield from [made] if isinstance(made, pa.RecordBatch) else made

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str | None, most: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    if text is None:
        yield batch
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and where each text starts (one more entry: the end). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: The bytes that end a word: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection), so that any of their bits can be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUE = _values()
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse, 0 to n - 1 at least."""
    if not _powers or len(_powers["up"]) < n:
        # a power of two, but not over what a slice needs, so that small texts don't hold tables for large ones
        size = max(n, min(1 << (n - 1).bit_length(), SLICE_BYTES + 1))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of texts that lie end to end, and the index of each text's first word (one more entry: all)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words (in order) with A-Z lower-cased: a polynomial over a table of random byte values, from prefix sums.

    Words are taken HASH_BYTES at a time: a hash doesn't depend on where its word stands, and sums and powers stay small.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        part = data[base : ends[to - 1]]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        start, end = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[end] - total[start]) * down[start])
        at = to
    return out


#: Any word of a text, as a regular expression of Spark's and DuckDB's.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, group: str, order: list[F.Column], value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of the same ``group`` (long, not null) that come earlier by ``order``.

    Rows are range-partitioned by group and order, so that a hot group spreads over tasks;
    each partition sums its own rows, and a small table of the partitions' sums by group
    gives where each starts. Rows that tie in ``order`` come in any order.
    """
    keys = [F.col(group), *order]
    names = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(names.index(group)).to_numpy(zero_copy_only=False)
            v = batch.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            before -= np.repeat(before[first], np.diff(np.r_[first, len(g)]))
            if g[0] == last:
                before[: first[1] if len(first) > 1 else None] += carried
            last, carried = g[-1], before[-1] + v[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(g), part, np.int32))], [*names, out, "_part"])

    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{out}` long, _part int"
    ranged = saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local, schema), "running")
    sums = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    return ranged.join(starts, [group, "_part"]).withColumn(out, F.col(out) + F.col("_start")).select(*names, out)


def put(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array under its name at once, so that a task that runs again does no harm."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        os.makedirs(at.path, exist_ok=True)
        own = f"{at.path}/.{name}-{uuid.uuid4().hex}"
        values.tofile(own)
        os.replace(own, f"{at.path}/{name}")
        return
    import pyarrow.fs

    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(np.ascontiguousarray(values))


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """The array, mapped into memory; from a store that can't be mapped, by way of an unlinked file."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        path = f"{at.path}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    import pyarrow.fs

    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as source:
        while part := source.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, kind, "r") if copy.tell() else np.zeros(0, kind)
