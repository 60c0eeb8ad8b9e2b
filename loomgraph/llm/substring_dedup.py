"""Substring dedup by hashing of units: sentences, lines or paragraphs.

Texts are cut into units, units are normalised (A-Z in lower case, runs of white space to one space, punctuation at the
ends dropped) and their digests are grouped over the corpus. The earliest occurrence (least doc_id, then offset) stays.
Of the others, runs of consecutive repeated units with at least `least_words` words together are removed, with their
offsets in the original text (bytes of UTF-8); shorter runs, such as a common phrase, stay. Grouping aggregates before
the shuffle and the join back to the units can be split, so one very common unit is no single task's work.

Defined cases: null and empty texts have no units and stay as they are; blank lines and lone punctuation belong to the
unit before them and so never end a run; rows that share doc_id and the crc32 of the text (doc) are one document and are cut alike; ties of doc_id go by that crc32,
and a null doc_id comes first. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.line_dedup import cut_spans
from loomgraph.llm.shared import save

LEAST_WORDS = 20
BREAKS = {"sentence": re.compile(rb"[.!?]+[ \t\r]+|[ \t\r]*\n\s*"), "line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n[ \t\r]*\n\s*")}
_ENDS = b".,;:!?\"'()[]"
_BLANK = _ENDS + b" \t\n\r\x0b\x0c"


def units_of(raw: bytes, kind: str = "sentence") -> list[tuple[int, int]]:
    """(start, end) of the units of a text; together they cover it. What has no word belongs to the unit before it."""
    cuts = [0, *(m.end() for m in BREAKS[kind].finditer(raw))]
    if cuts[-1] != len(raw):
        cuts.append(len(raw))
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    kept = [cuts[0], *(a for a, b in parts[1:] if raw[a:b].strip(_BLANK)), cuts[-1]]
    return list(zip(kept[:-1], kept[1:], strict=True))


def normalised(unit: bytes) -> tuple[bytes, int]:
    """The normalised unit and its number of words."""
    words = unit.lower().split()
    return b" ".join(words).strip(_ENDS + b" "), sum(1 for w in words if w.strip(_ENDS))


def _units(kind: str):
    names = ["doc_id", "doc", "no", "start", "end", "words", "digest"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        for batch in batches:
            rows = [[] for _ in names]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not raw:
                    continue
                doc = zlib.crc32(raw)
                for no, (start, end) in enumerate(units_of(raw, kind)):
                    plain, words = normalised(raw[start:end])
                    if plain:
                        for column, x in zip(rows, (doc_id, doc, no, start, end, words, xxhash.xxh3_128_digest(plain)), strict=True):
                            column.append(x)
                if len(rows[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    return run


def repeated_spans(docs: DataFrame, kind: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, doc, start, end, units, words, keeper_ids) of the runs to remove, from columns doc_id and text.

    keeper_ids are the documents whose occurrences stay.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = docs.mapInArrow(_units(kind), "doc_id long, doc long, no int, start long, end long, words int, digest binary")
    place = F.struct("doc_id", "doc", "start")
    first = save(units.groupBy("digest").agg(F.min(place).alias("keeper"), F.max(place).alias("last")).where("keeper <> last").select("digest", "keeper"), "repeated")
    again = units.join(first, "digest").where(place != F.col("keeper")).select("doc_id", "doc", "no", "start", "end", "words", F.col("keeper.doc_id").alias("keeper_id")).distinct()
    by_doc = Window.partitionBy("doc_id", "doc").orderBy("no")
    runs = again.withColumn("run", F.col("no") - F.row_number().over(by_doc)).groupBy("doc_id", "doc", "run")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("units"), F.sum("words").alias("words"), F.array_sort(F.collect_set("keeper_id")).alias("keeper_ids"))
    return runs.where(F.col("words") >= least_words).drop("run")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated runs cut out of text; all other columns as they are."""
    return cut_spans(docs, repeated_spans(docs, **options))
