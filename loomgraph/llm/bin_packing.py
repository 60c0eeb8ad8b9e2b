"""Best-fit packing of tokenised documents into sequences, by bin completion over the histogram of piece lengths.

Documents are encoded once, in tasks; only documents longer than a sequence are cut. Pieces as long as a sequence fill
one each. For the others only the number of pieces of each length matters to a packing, so the problem that is solved
has at most capacity - 1 numbers however many documents there are. complete_bins() solves it: best-fit decreasing gives
the first incumbent. If that is above the lower bound, a branch-and-bound fills the bin of the largest piece left with
undominated fillings (each applied as often as the counts allow), prunes what wastes more than a better solution could,
and keeps better solutions as incumbents. After it the least full bins, `most_bins` of them or a few times as many, are
packed anew by the same search, as long as that saves a bin. A search visits at most `most_nodes` nodes, weighs at most
`width` fillings of a bin and looks for them in a walk of `tries` steps, so the driver's work has a bound that does not
grow with the documents. The incumbent is complete at any time, so
no document is left out. Pieces then find their place by their rank among the pieces of their length.

Defined cases: a null or empty text is one piece, the end id. Repeated rows are packed each. A null doc_id stays null.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import save, text_slices
from loomgraph.llm.tokens import SegmentEncoder

SLICE = 1 << 22  # bytes of texts that are encoded together
Pattern = tuple[int, tuple[int, ...]]  # how many bins are filled alike, and the lengths in them


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, bins with equal contents being handled together."""
    free: dict[int, list[Pattern]] = {}
    mask = 0  # bit r: bins with r free places exist

    def put(room: int, times: int, items: tuple[int, ...]) -> None:
        nonlocal mask
        free.setdefault(room, []).append((times, items))
        mask |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not (fits := mask >> length):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, full, (length,) * each)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                break
            room = length + (fits & -fits).bit_length() - 1
            times, items = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            take = min(times, left)
            if times > take:
                put(room, times - take, items)
            put(room - length, take, (*items, length))
            left -= take
    return [p for group in free.values() for p in group]


def bins(patterns: list[Pattern]) -> int:
    return sum(times for times, _ in patterns)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces of which no two share a bin, with what cannot join them."""
    if not counts:
        return 0
    n = np.array(sorted(counts), dtype=np.int64)
    c = np.array([counts[x] for x in n.tolist()], dtype=np.int64)
    pieces, volume = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(n * c)))
    k = np.concatenate(([0], n[2 * n <= capacity]))
    low, half, high = (np.searchsorted(n, x, side=s) for x, s in ((k, "left"), (capacity // 2, "right"), (capacity - k, "right")))
    over = pieces[-1] - pieces[half]  # no two of them share a bin
    room = (pieces[high] - pieces[half]) * capacity - (volume[high] - volume[half])
    small = volume[half] - volume[low]
    return int(max(-(-volume[-1] // capacity), (over + np.maximum(0, -(-(small - room) // capacity))).max()))


def _fits_into(items: tuple[int, ...], rooms: list[int]) -> bool:
    if not items:
        return True
    for i, room in enumerate(rooms):
        if items[0] <= room and room not in rooms[:i] and _fits_into(items[1:], [*rooms[:i], room - items[0], *rooms[i + 1 :]]):
            return True
    return False


def undominated_fillings(counts: dict[int, int], room: int, waste: int, width: int, tries: int = 4000) -> list[tuple[int, ...]]:
    """Fillings of room that leave at most waste free, the least waste first; none fits item by item into another.

    At most width of them, from a depth-first walk of at most `tries` steps that tries large pieces first.
    """
    lengths = sorted((n for n in counts if counts[n] and n <= room), reverse=True)
    if room in lengths:
        return [(room,)]  # dominates every other
    found: list[tuple[int, ...]] = []
    steps = 0

    def walk(at: int, left: int, items: tuple[int, ...]) -> None:
        nonlocal steps
        fits = False
        for i in range(at, len(lengths)):
            n = lengths[i]
            if n > left or items.count(n) >= counts[n]:
                continue
            fits = True
            steps += 1
            if steps > tries:
                return
            walk(i, left - n, (*items, n))
            if len(found) >= 8 * width:
                return
        if left <= waste and (not fits or left == 0):
            found.append(items)

    walk(0, room, ())
    found.sort(key=lambda f: (room - sum(f), len(f), tuple(-n for n in f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(len(f) <= 8 and len(k) <= 4 and _fits_into(f, list(k)) for k in kept):
            kept.append(f)
    return kept[:width]


def _search(counts: dict[int, int], capacity: int, most_nodes: int, width: int) -> list[Pattern]:
    """Branch-and-bound by bin completion from best-fit decreasing as the first incumbent."""
    incumbent = best_fit_decreasing(counts, capacity)
    least = lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    stack = [(counts, [], 0)]
    nodes = 0
    while stack and bins(incumbent) > least and nodes < most_nodes:
        left, made, wasted = stack.pop()
        nodes += 1
        allowed = (bins(incumbent) - 1) * capacity - total - wasted
        if allowed < 0:
            continue
        if len(left) <= 64 or nodes % 32 == 0 or nodes == most_nodes:  # large histograms: not at every node
            rest = best_fit_decreasing(left, capacity)
            if bins(made) + bins(rest) < bins(incumbent):
                incumbent = made + rest
        if not left or bins(made) + -(-sum(n * c for n, c in left.items()) // capacity) >= bins(incumbent):
            continue
        largest = max(left)
        others = Counter(left)
        others[largest] -= 1
        for filling in reversed(undominated_fillings(others, capacity - largest, allowed, width)):
            bin_ = (largest, *filling)
            need = Counter(bin_)
            most = min(left[n] // k for n, k in need.items())
            waste = capacity - sum(bin_)
            if waste:
                most = min(most, max(1, allowed // waste))
            for times in sorted({1, most}):
                after = {n: c - times * need[n] for n, c in left.items() if c > times * need[n]}
                stack.append((after, [*made, (times, bin_)], wasted + times * waste))
    return incumbent


def _least_full(patterns: list[Pattern], capacity: int, most: int) -> tuple[list[Pattern], list[Pattern]]:
    """(about `most` bins: those with the most waste, else of the most different patterns; the others)."""
    taken, others, room = [], [], most
    for times, items in sorted(patterns, key=lambda p: (sum(p[1]) - capacity, p[1])):
        take = min(times, room, times if sum(items) < capacity else 1)
        room -= take
        taken += [(take, items)] if take else []
        others += [(times - take, items)] if times > take else []
    return taken, others


def complete_bins(counts: dict[int, int], capacity: int, most_nodes: int = 300, width: int = 4, most_bins: int = 48) -> list[Pattern]:
    """A packing of counts[length] pieces of each length as patterns; the fewest bins found (see the module's text)."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece does not fit")
    best = _search(counts, capacity, most_nodes, width)
    least = lower_bound(counts, capacity)
    size = most_bins
    while bins(best) > least:
        part, others = _least_full(best, capacity, size)
        held: Counter = Counter()
        for times, items in part:
            for n in items:
                held[n] += times
        better = _search(dict(held), capacity, most_nodes, width)
        if bins(better) < bins(part):
            best = others + better
        elif others and size < 4 * most_bins:
            size *= 2
        else:
            break
    return best


class Places:
    """Where the r-th piece of each length goes: sequence number and offset."""

    def __init__(self, patterns: list[Pattern]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for times, items in patterns:
            at = 0
            for n in items:
                slots.setdefault(n, []).append((times, first, at))
                at += n
            first += times
        self.by_length = {}
        for n, rows in slots.items():
            times, firsts, offsets = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            self.by_length[n] = (np.cumsum(times), times, firsts, offsets)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            ends, times, firsts, offsets = self.by_length[int(n)]
            slot = np.searchsorted(ends, rank[rows], side="right")
            sequence[rows] = firsts[slot] + rank[rows] - (ends[slot] - times[slot])
            offset[rows] = offsets[slot]
        return sequence, offset


def _pieces(tokenizer: str, end: int, capacity: int):
    """Task: the pieces of documents; rank counts the pieces of each length within the task's part."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]

    def run(batches):
        encoder, part = SegmentEncoder.of(tokenizer), TaskContext.get().partitionId()
        ranks: Counter = Counter()
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for at, data, bounds in text_slices(batch.column(1), SLICE):
                ids, offsets = encoder.encode(data, bounds, end)
                rows = []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for piece, start in enumerate(range(a, b, capacity)):
                        n = min(capacity, b - start)
                        rows.append((ids_of[at + i], piece, start - a, n, zlib.crc32(ids[start : start + n]), part, ranks[n]))
                        ranks[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    return run


def _placed(places, names: list[str]):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = places.value.of(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = save(docs.mapInArrow(_pieces(tokenizer, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.col("part") * (1 << 32) - F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    counts = save(rest.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # at most capacity - 1 rows
    places = spark.sparkContext.broadcast(Places(complete_bins(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rest.join(bases.hint("merge"), ["part", "length"]).select(*names, (F.col("base") + F.col("rank")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(places, names), schema).union(full)
