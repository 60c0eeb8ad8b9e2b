"""Helpers that the training-data operators share: scratch tables, hashing of word shingles, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without these bytes (space, tab, newline, vertical tab, form feed, return).
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests), a fresh one under /tmp/checkpoints."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4()}")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by save(), once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ shingles

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def byte_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each of the byte strings data[bounds[i] : bounds[i + 1]]."""
    size, starts, lengths = len(data), bounds[:-1], np.diff(bounds).astype(np.uint64)
    out = []
    for table, base, lane in ((_BYTE, _BASE, _LANE[63]), (_OTHER_BYTE, _INVERSE, _LANE[62])):
        running = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(table[data] * _powers(base, size), dtype=np.uint64, out=running[1:])
        out.append(mix((running[bounds[1:]] - running[starts]) * _powers(pow(base, -1, 2**64), size + 1)[starts] + lengths * lane))
    return out[0], out[1]


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of texts that lie one after another in data (UTF-8 bytes).

    bounds: n + 1 offsets of the texts. Returns the hashes and n + 1 offsets into them. A text with fewer than k
    words has one hash for the whole sequence; a text without words has none.
    """
    n_docs, size = len(bounds) - 1, int(bounds[-1] - bounds[0])
    data = _LOWER[data[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = ~_IS_SEPARATOR[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if size else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if size else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    running = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, size), dtype=np.uint64, out=running[1:])
    words = mix((running[ends] - running[starts]) * _powers(_INVERSE, size)[starts] + (ends - starts).astype(np.uint64) * _LANE[63])
    first = np.searchsorted(starts, bounds[:-1])  # each text's first word
    count = np.diff(np.concatenate((first, [len(starts)])))
    made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(offsets[-1], dtype=np.uint64)
    if len(words) >= k:
        rolled = sum(words[j : len(words) - k + 1 + j] * _LANE[j] for j in range(k))
        full = np.repeat(count >= k, made)
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, made)
        out[full] = rolled[at[full]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[offsets[i] : offsets[i + 1]] = (words[first[i] : first[i] + count[i]] * _LANE[: count[i]]).sum(dtype=np.uint64, keepdims=True) + _LANE[40 + count[i]]
    assert len(offsets) == n_docs + 1
    return mix(out), offsets


def text_slices(column: pa.Array, most: int = 1 << 21):
    """Yields (first row, bytes, bounds) for runs of rows with about `most` bytes; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1)
        yield row, data, bounds[row : to + 1]
        row = to


def shingle_sets(column: pa.Array, k: int):
    """Yields (row, sorted distinct shingle hashes) for each text."""
    for row, data, bounds in text_slices(column):
        hashes, offsets = shingle_hashes(data, bounds, k)
        for i in range(len(bounds) - 1):
            yield row + i, np.unique(hashes[offsets[i] : offsets[i + 1]])


# ------------------------------------------------------------------ connected components


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to rows (node, root), root being the least node of its component.

    Alternates large-star and small-star (Kiveris et al., 2014); every round is two aggregations and two joins over
    at most |E| + |V| rows and is written out. Nodes that no edge names have no row; nulls and loops are ignored.
    """
    held = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).union(held.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = save(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = save(large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small).distinct(), "edges")
        forget(large)
        forget(held)
        held = after
    else:
        raise RuntimeError("components did not settle")
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
