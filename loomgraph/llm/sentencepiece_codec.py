"""SentencePiece encoding and decoding with a streaming Viterbi over a bounded window.

A text is read from left to right. For each position the encoder keeps the piece that ends there on the best path, which
is a backpointer; only the last `longest piece` positions can be reached again, so the window is bounded. As soon as the
surviving backpointer paths run through one boundary, the ids up to it are committed and forgotten. A boundary between
two characters that no piece holds side by side is always such a point, so segments between these points are encoded on
their own; the ids of a segment up to the next space are remembered in a memo of a bounded size.

Two kinds of model. In a unigram model the best path has the greatest sum of scores. In a BPE model, whose scores rank
merges, a path is good when every two pieces next to each other on it are what merging their texts alone gives; exactly
one piece that ends at a position fits its good path, and the whole path is the text's BPE encoding. (Viterbi over BPE
ranks as if they were log-probabilities would give other ids than the SentencePiece library; this gives the same.)

Texts are handled as the models with identity normalisation want it: spaces become U+2581 and one is put in front. A
character without a piece becomes its UTF-8 byte pieces.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are coded each; extra
columns are kept, but for those named as a column that is added, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.shared import text_slices
from loomgraph.llm.tokens import SegmentMemo, tokenizer_path

SPACE = "▁"
SLICE = 1 << 21  # bytes of texts that are encoded together
_MOST_FITTING = 1 << 18
_LOADED: dict = {}


class Pieces:
    """The pieces of a model: ids and scores, bytes, and which characters stand side by side in a piece."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int], unknown: int, bpe: bool):
        self.ids, self.scores, self.byte_ids, self.unknown, self.bpe = pieces, scores, byte_ids, unknown, bpe
        self.longest = max(map(len, pieces), default=1)
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.text_of = {i: p for p, i in pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.spaced = any(pair[1] == SPACE and pair[0] != SPACE for pair in self.pairs)  # a piece may span a space
        self.bytes_of = {i: p.encode() for p, i in pieces.items()} | {i: bytes([b]) for i, b in self.byte_of.items()} | {unknown: "⁇".encode()}
        self.memo = SegmentMemo()
        self.weighed = 0  # entries of fitting
        self.fitting: dict[str, dict[str, bool]] = {}  # left piece -> right piece -> whether they stay apart
        self.made: dict[str, tuple[str, str] | None] = {}
        self.tree: dict = {}  # character -> [tree of what follows, the piece that ends here or None]
        for piece in pieces:
            node: list = [self.tree, None]
            for character in piece:
                node = node[0].setdefault(character, [{}, None])
            node[1] = piece

    @classmethod
    def of(cls, name: str) -> "Pieces":
        if name not in _LOADED:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=name if os.path.isabs(name) else tokenizer_path(name))
            plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
            ids = {model.id_to_piece(i): i for i in plain}
            scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
            byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
            if not model.is_byte(byte_ids[0]):
                byte_ids = []
            bpe = all(float(s).is_integer() for s in scores.values())  # ranks of merges; log-probabilities are not whole
            _LOADED[name] = cls(ids, scores, byte_ids, model.unk_id(), bpe)
        return _LOADED[name]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece, when its text alone is merged; None if it merges to something else."""
        if piece not in self.made:
            out, last = list(piece), ("", "")
            while len(out) > 1:
                scored = [(self.scores.get(x + y, float("-inf")), -i) for i, (x, y) in enumerate(zip(out[:-1], out[1:], strict=True))]
                score, at = max(scored)
                if score == float("-inf"):
                    break
                last = (out[-at], out[1 - at])
                out[-at : 2 - at] = ["".join(last)]
            self.made[piece] = last if len(out) == 1 else None
        return self.made[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the texts of both together leaves them as they are.

        Looks back in time at the parts that face each other at the border: a merge across it spoils the pair if it comes
        before the merge that took one of the two parts into a larger one. Of equal merges the first in the text comes first.
        """
        if self.halves(right) is None:
            return False
        if not left:
            return True
        a, b, limit, on_right = left, right, float("-inf"), False
        while True:
            across = self.scores.get(a + b)
            if across is not None and (across > limit or (across == limit and on_right)):
                return False
            when_a = self.scores[a] if len(a) > 1 else float("inf")
            when_b = self.scores[b] if len(b) > 1 else float("inf")
            if when_a == when_b == float("inf"):
                return True
            if when_a < when_b:
                limit, on_right, a = when_a, False, self.halves(a)[1]
            else:
                limit, on_right, b = when_b, True, self.halves(b)[0]

    def segment(self, text: str) -> list[int]:
        """The ids of a segment: a window of backpointers, committed where the surviving paths meet."""
        ids: list[int] = []
        size, longest, bpe, fitting = len(text), self.longest, self.bpe, self.fitting
        base = 0  # path and best are windows: entry i is for position base + i
        path: list[str] = [""] * (min(size, longest) + 1)  # the piece that ends at each position
        best = [0.0] + [float("-inf")] * (len(path) - 1)
        for start in range(size):
            if start + longest > base + len(path) - 1 and base + len(path) <= size:
                path.append("")
                best.append(float("-inf"))
            left = path[start - base]
            if start and not left:
                continue
            if bpe and (row := fitting.get(left)) is None:
                row = fitting[left] = {}
            below, end = self.tree, start - base
            for character in text[start : start + longest]:
                end += 1
                if (node := below.get(character)) is None:
                    break
                below, piece = node
                if piece is None:
                    continue
                if not bpe:
                    score = best[start - base] + self.scores[piece]
                    if score > best[end]:
                        best[end], path[end] = score, piece
                elif not path[end]:
                    if (fit := row.get(piece)) is None:
                        fit = row[piece] = self.fits(left, piece)
                        self.weighed += 1
                    if fit:
                        path[end] = piece
            after = start + 1 - base
            if not path[after] and text[start] not in self.ids:  # a character without a piece
                path[after], best[after] = text[start], best[start - base] - 1e6
            if after > 2 * longest and (done := self._meeting(path, after)):
                self._emit(path, done, ids)
                base += done
                del path[:done], best[:done]  # path[0] stays: what follows must still fit the last committed piece
        self._emit(path, size - base, ids)
        if self.weighed > _MOST_FITTING:
            fitting.clear()
            self.weighed = 0
        return ids

    def _meeting(self, path: list[str], after: int) -> int:
        """The place in the window where the paths to all positions from `after` on meet; 0 if there is none yet."""
        reach = {p for p in range(after, min(after + self.longest, len(path))) if path[p]}
        while len(reach) > 1:
            far = max(reach)
            reach.remove(far)
            reach.add(far - len(path[far]))
        return reach.pop() if reach else 0

    def _emit(self, path: list[str], end: int, ids: list[int]) -> None:
        """Adds the ids of the path from the window's start to end."""
        found = []
        while end > 0:
            found.append(path[end])
            end -= len(path[end])
        for piece in reversed(found):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)

    def _learn(self, keys: list[str]) -> tuple[list[int], list[int]]:
        """The ids of segments in one list and their numbers; a segment is cut further between characters that no piece holds side by side."""
        out: list[int] = []
        sizes, pairs = [], self.pairs
        for key in keys:
            before, start, text = len(out), 0, key.replace(" ", SPACE)
            for i in range(1, len(text)):
                if text[i - 1 : i + 1] not in pairs:
                    out += self.segment(text[start:i])
                    start = i
            out += self.segment(text[start:])
            sizes.append(len(out) - before)
        return out, sizes

    def encode_texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that lie one after another in data (UTF-8 bytes) at bounds."""
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        if (data[:-1][data[1:] == 0x96] == 0xE2).any():  # a text may hold the sign for spaces itself, which then is one
            parts = [data[a:b].tobytes().replace(SPACE.encode(), b" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        texts = np.flatnonzero(np.diff(bounds))
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        data = np.insert(data, bounds[texts], 32)  # the space in front of each text
        firsts = bounds[texts] + np.arange(len(texts))
        cut = data == 32
        if self.spaced:
            cut[:] = False
        else:  # runs of spaces have pieces of their own
            cut[1:] &= data[:-1] != 32
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        ids, made = self.memo.encode(data, np.append(starts, len(data)), self._learn)
        ends = np.concatenate(([0], np.cumsum(made)))
        return ids, ends[np.searchsorted(starts, np.append(firsts, len(data)))][np.searchsorted(texts, np.arange(len(bounds)))]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian 32-bit integers."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_texts(raw, np.array([0, len(raw)]))[0].tobytes()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = raw.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def _encoded(names: list[str], model: str, text_col: str):
    """Task: batches of the columns `names` with ids behind them."""

    def run(batches):
        pieces = Pieces.of(model)
        for batch in batches:
            for first, data, bounds in text_slices(batch.column(text_col), SLICE):
                ids, offsets = pieces.encode_texts(data, bounds)
                part = batch.slice(first, len(bounds) - 1)
                made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], names=[*names, "ids"])

    return run


def _decoded(names: list[str], model: str, ids_col: str):
    """Task: batches of the columns `names` with decoded and ids_crc32 behind them."""

    def run(batches):
        pieces = Pieces.of(model)
        for batch in batches:
            texts, crcs = [], []
            for ids in batch.column(ids_col):
                values = np.zeros(0, np.int32) if not ids.is_valid else ids.values.to_numpy()
                texts.append(pieces.decode(values))
                crcs.append(zlib.crc32(values.astype("<u4", copy=False)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(crcs, pa.int64())], names=[*names, "decoded", "ids_crc32"])

    return run


def _schema(df: DataFrame, names: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[n] for n in names), *T.StructType.fromDDL(more).fields])


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text") -> DataFrame:
    """docs with a column ids (array<int>)."""
    names = [n for n in docs.columns if n != "ids"]
    return docs.mapInArrow(_encoded(names, model, text_col), _schema(docs, names, "ids array<int>"))


def decode_pieces(coded: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """coded with columns decoded (string) and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    names = [n for n in coded.columns if n not in ("decoded", "ids_crc32")]
    return coded.mapInArrow(_decoded(names, model, ids_col), _schema(coded, names, "decoded string, ids_crc32 long"))


def pieces_digest(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Rows (doc_id, n_pieces, ids_crc32, decoded_sha256, same): every text encoded and its ids decoded again."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    there, back = _encoded(["doc_id", "text"], model, "text"), _decoded(["doc_id", "text", "ids"], model, "ids")
    read = plain.mapInArrow(lambda batches: back(there(batches)), "doc_id long, text string, ids array<int>, decoded string, ids_crc32 long")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same"))
