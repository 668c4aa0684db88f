"""Shared helpers: the shared folder, Arrow text buffers, NumPy hashing kernels, graph components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass handles; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 21
#: A side is broadcast only if its measured row count times its row width stays below this.
BROADCAST_BYTES = 16 << 20


# --- the shared folder -------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a local one is set, but only if the executors are local too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siltstone-"))
            current = spark.sparkContext.getCheckpointDir()
        base = current
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised frame that nothing reads any more."""
    path = getattr(df, "_siltstone_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, payload: bytes) -> None:
    """Write a whole file from a task. Names hold a fresh id for each attempt, so that a retried or
    speculative task never touches a file that another attempt has reported."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(payload)


def mapped(uri: str) -> np.ndarray:
    """A file's bytes, memory-mapped; a remote file is first copied to an unlinked temporary file."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        size = os.path.getsize(path)
        return np.memmap(path, np.uint8, "r") if size else np.zeros(0, np.uint8)
    handle, name = tempfile.mkstemp()
    os.unlink(name)
    with fs.open_input_stream(path) as source, os.fdopen(handle, "w+b") as copy:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        size = copy.tell()
        return np.memmap(copy, np.uint8, "r", shape=(size,)) if size else np.zeros(0, np.uint8)


def settle() -> None:
    """Give back what earlier steps have left in this worker process, and return large arrays at once from
    now on: workers outlive their tasks, and free lists would hold the largest needs of all steps."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


# --- Arrow text buffers ------------------------------------------------------------------------


def text_frame(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select("doc_id", "text", *extra)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets in them; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


# --- hashing kernels ---------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240521))
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; the hash of any slice comes from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:], dtype=np.uint64)
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    top = int(start.max()) + 1 if len(start) else 1
    return mix((prefix[end] - prefix[start]) * powers(BASE_INV, top)[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without ASCII white space) and the first word of each row."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def window_hash(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours of ``codes``."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    weight = 1
    for j in range(size):
        out += codes[j : j + n] * np.uint64(weight)
        weight = weight * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(out)


def window_rows(first: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` windows lie within one row, and the row of each element."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[:n] == row[size - 1 : size - 1 + n] if n > 0 else np.zeros(0, bool)
    return inside, row


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# --- size-checked joins and components ---------------------------------------------------------


def small_or_plain(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the (already materialised) side is measured small; else none."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as rows (node, root); root is the smallest node reached.

    Alternates large-star and small-star steps, each a group-by with partial aggregation and one
    join, until the sum of the edges stops changing. Each round is written to the shared folder.
    Self edges are allowed (a node alone). Stars hang nodes on their minimum, so that no step makes
    more rows than it has read, and a hub of any degree is spread by the join's skew handling."""
    e = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = materialise(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = materialise(nodes, "nodes")
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, large.a == low.k).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialise(small.where("a <> b").distinct(), "edges")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = after
        if tuple(told) == seen:
            break
        seen = tuple(told)
    else:
        raise RuntimeError("components did not converge")
    root = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("n2"), "root")
    return nodes.join(root, nodes.node == root.n2, "left").select("node", F.coalesce("root", "node").alias("root"))
