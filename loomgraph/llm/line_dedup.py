"""Line dedup by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last `window` line hashes ends a chunk wherever it is 0 modulo `divisor`, so
chunk boundaries depend on the lines around them alone and survive lines put in or taken out elsewhere. Chunks of two or
more lines whose digest occurs twice or more in the corpus are compared byte by byte with the earliest occurrence (least
doc_id, then place); those that are equal are removed, the earliest is kept. The digests go to the shuffle in small rows;
only repeated chunks bring their bytes.

Lines end at newlines, which belong to their line, so what stays is the concatenation of the kept chunks. Offsets are in
bytes of UTF-8. Defined cases: a null text stays null and an empty one empty; rows that share doc_id and the crc32 of
the text (doc) are one document and are cut alike; ties of doc_id go by that crc32, a null doc_id comes first; extra columns are
kept as they are. Chunks without a word are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import mix, save

WINDOW, DIVISOR = 2, 3
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def chunk_bounds(raw: bytes, window: int = WINDOW, divisor: int = DIVISOR) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the chunks of a text."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    starts = np.concatenate(([0], ends[:-1]))
    hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b].rstrip(b"\n")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    rolled = np.zeros(len(hashes), np.uint64)
    for j in range(min(window, len(hashes))):
        rolled[j:] += hashes[: len(hashes) - j] * _LANES[j]
    cut = np.flatnonzero(mix(rolled) % np.uint64(divisor) == 0) + 1
    if not len(cut) or cut[-1] != len(ends):
        cut = np.append(cut, len(ends))
    first = np.concatenate(([0], cut[:-1]))
    return [(int(starts[a]), int(ends[b - 1]), int(b - a)) for a, b in zip(first, cut, strict=True)]


def _chunks(window: int, divisor: int, least: int):
    names = ["doc_id", "doc", "start", "end", "digest"]

    def run(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                doc = zlib.crc32(text)
                for start, end, lines in chunk_bounds(text, window, divisor):
                    part = text[start:end].rstrip(b"\n")
                    if lines >= least and part.strip():
                        for column, x in zip(rows, (doc_id, doc, start, end, xxhash.xxh3_128_digest(part)), strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    return run


def _cut(spans: list[dict] | None, raw: bytes) -> bytes:
    kept, at = [], 0
    for span in sorted(spans or [], key=lambda s: s["start"]):
        kept.append(raw[at : span["start"]])
        at = max(at, span["end"])
    return b"".join([*kept, raw[at:]])


def repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least: int = 2) -> DataFrame:
    """Rows (doc_id, doc, start, end, digest, keeper_id, keeper_start) of the chunks to remove, from columns doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = save(docs.mapInArrow(_chunks(window, divisor, least), "doc_id long, doc long, start long, end long, digest binary"), "chunks")
    place = F.struct("doc_id", "doc", "start")
    first = save(chunks.groupBy("digest").agg(F.min(place).alias("keeper"), F.max(place).alias("last")).where("keeper <> last").select("digest", "keeper"), "repeated")
    rows = chunks.join(first, "digest").withColumn("keeps", place == F.col("keeper"))
    spans = rows.groupBy("doc_id", "doc").agg(F.collect_set(F.struct("digest", "start", "end", "keeper", "keeps")).alias("spans"))
    # only repeated chunks bring their bytes
    held = docs.alias("t").join(spans.alias("w"), F.expr("w.doc_id <=> t.doc_id and w.doc = crc32(t.text)")).select("w.doc_id", "w.doc", "t.text", F.explode("w.spans").alias("s"))
    part = F.expr("rtrim('\n', cast(substring(cast(text as binary), cast(s.start as int) + 1, cast(s.end - s.start as int)) as string))")
    parts = save(held.select("doc_id", "doc", "s.*", part.alias("bytes")).distinct(), "parts")
    keepers = parts.where("keeps").select("digest", F.col("bytes").alias("kept"))
    same = parts.where("not keeps").join(keepers, "digest").where("bytes = kept")
    return same.select("doc_id", "doc", "start", "end", "digest", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.start").alias("keeper_start"))


def cut_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Cuts the byte spans (doc_id, doc, start, end) out of the texts of docs; all other columns as they are."""
    spans = found.groupBy("doc_id", "doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    held = docs.alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and crc32(d.text) = s.doc"), "left").select(*[F.col(f"d.`{n}`") for n in docs.columns], F.col("s.spans").alias("__spans"))
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in batches:
            spans_ = batch.column(len(names)).to_pylist()
            changed = [t.as_py() if not s or not t.is_valid else _cut(s, t.as_py().encode()).decode() for s, t in zip(spans_, batch.column(at), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(changed, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return held.mapInArrow(cut, docs.schema)


def remove_chunks(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated chunks cut out of text."""
    return cut_spans(docs, repeated_chunks(docs, **options))
