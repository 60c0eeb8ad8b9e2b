"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

write_tokens() range-partitions documents by doc_id, encodes each once and writes one row per block into Parquet
shards: the documents' ids and lengths, the ids that occur in the block in order of their frequency there, a control
stream of two bits for each id (the number of bytes of its rank, less one) and a data stream of those bytes. A block
needs nothing beside itself to be read, and its rank table is at most as long as the vocabulary. read_tokens() decodes
blocks by table lookup.

Defined cases: a null text is the empty text, whose only id is the end id. Rows are ordered by doc_id, nulls first, ties
by text; repeated rows are all written. An empty table gives no blocks and an empty result. Other columns are ignored.
Any number of ids below 2**32 can be coded. A block holds whole documents, and a document above the block size is a
block of its own.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import shared_folder, shuffle_partitions, text_slices
from loomgraph.llm.tokens import SegmentEncoder

BLOCK_IDS, SLICE = 1 << 21, 1 << 22
_LENGTHS = np.array([[(c >> (2 * j) & 3) + 1 for j in range(4)] for c in range(256)], dtype=np.uint8)
_FIRST = np.arange(4, dtype=np.uint8)
BLOCK = "shard int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, ranked binary, control binary, data binary"


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[_FIRST <= extra[:, None]].tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = raw[starts].astype("<u4")
    longer = np.flatnonzero(lengths > 1)
    for byte in (1, 2, 3):
        out[longer] |= raw[starts[longer] + byte].astype("<u4") << np.uint32(8 * byte)
        longer = longer[lengths[longer] > byte + 1]
    return out


def _blocks(tokenizer: str, end: int, block_ids: int):
    def run(batches):
        encoder, shard = SegmentEncoder.of(tokenizer), TaskContext.get().partitionId()
        docs, lengths, held, size, block, first = [], [], [], 0, 0, 0

        def block_row():
            ids = np.concatenate(held)
            counts = np.bincount(ids)
            ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
            ranks = np.zeros(len(counts), np.uint32)
            ranks[ranked] = np.arange(len(ranked), dtype=np.uint32)
            control, data = pack_ids(ranks[ids])
            row = [[shard], [block], [first], [size], [docs], [lengths], [ranked.astype("<u4").tobytes()], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, data, bounds in text_slices(batch.column(1), SLICE):
                ids, offsets = encoder.encode(data, bounds, end)
                offsets = offsets.tolist()
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    n = b - a
                    if size and size + n > block_ids:
                        yield block_row()
                        block, first = block + 1, first + size
                        docs, lengths, held, size = [], [], [], 0
                    docs.append(names[at + i])
                    lengths.append(n)
                    held.append(ids[a:b])
                    size += n
        if docs:
            yield block_row()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end: int = 0, shards: int | None = None, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the blocks of all documents into folder."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer, end, block_ids), BLOCK).write.parquet(folder)


def _decoded(bases: dict[int, int], digest: bool = False):
    """Task: the documents of each block with their ids, or with the crc32 of those."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                by_rank = np.frombuffer(row["ranked"].as_buffer(), "<u4")
                ids = by_rank[unpack_ids(row["control"].as_buffer(), row["data"].as_buffer(), row["n_ids"].as_py())]
                lengths = row["lengths"].values
                bounds = np.concatenate(([0], np.cumsum(lengths.to_numpy(), dtype=np.int64)))
                start = bases[row["shard"].as_py()] + row["first"].as_py() + bounds[:-1]
                spans = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                last = pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()) if digest else pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start), lengths, last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from files of write_tokens(); ids are little-endian unsigned 32-bit.

    digest: ids_crc32 in place of the ids.
    """
    blocks = spark.read.schema(BLOCK).parquet(folder)
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())  # one row per shard
    bases, before = {}, 0
    for shard in sorted(totals):
        bases[shard], before = before, before + totals[shard]
    return blocks.mapInArrow(_decoded(bases, digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes the files, reads them back and returns doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    write_tokens(docs, folder, **options)
    return read_tokens(spark, folder, digest=True)
