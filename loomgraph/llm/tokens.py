"""Encoding with a public tokenizer file inside tasks, remembering the ids of text segments that it encodes alike anywhere.

A batch of texts is cut into segments, which Arrow reduces to the distinct ones; of these only the unknown ones go to the
tokenizers library, and the ids of all are put together by gathers. SegmentMemo holds what is known in plain arrays of a
bounded size, so a worker's memory does not grow with the texts it has seen.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from loomgraph.llm.shared import byte_hashes

MOST_SEGMENTS, MOST_IDS, LONGEST = 3 << 19, 5 << 20, 64  # entries and ids of a memo (at most 62 MB) and the bytes of a segment in it
_STOPS = (".", ",")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of white space beyond ASCII and, for each, what may follow; texts that hold any are not cut.
_ODD_SPACE = ((b"\xc2", (b"\x85", b"\xa0")), (b"\xe1", (b"\x9a",)), (b"\xe2", (b"\x80", b"\x81")), (b"\xe3", (b"\x80",)))


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_CHARACTERS = _byte_characters()
_LOADED: dict[str, "SegmentEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + sizes[0]], then the next ones, in one array."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class SegmentMemo:
    """The ids of segments, each known by two 64-bit hashes.

    When it is full, the entries that were not looked up since the last time go, or all if that leaves too many.
    """

    def __init__(self, most: int = MOST_SEGMENTS, most_ids: int = MOST_IDS):
        self.most, self.most_ids = most, most_ids
        self._hold(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4"))

    def _hold(self, keys, checks, starts, sizes, ids) -> None:
        self.keys, self.checks, self.starts, self.sizes, self.ids = keys, checks, starts, sizes, ids
        self.used = np.zeros(len(keys), bool)

    def _add(self, keys, checks, sizes, ids) -> None:
        if len(self.keys) + len(keys) > self.most or len(self.ids) + len(ids) > self.most_ids:
            keep = np.flatnonzero(self.used)
            if 2 * (len(keep) + len(keys)) > self.most or 2 * (int(self.sizes[keep].sum()) + len(ids)) > self.most_ids:
                keep = keep[:0]
            sizes_ = self.sizes[keep]
            kept = gathered(self.ids, self.starts[keep], sizes_)
            self._hold(self.keys[keep], self.checks[keep], (np.cumsum(sizes_) - sizes_).astype(np.int32), sizes_, kept)
        starts = (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        used = np.insert(self.used, at, False)
        put = lambda held, new: np.insert(held, at, new[order])
        self._hold(put(self.keys, keys), put(self.checks, checks), put(self.starts, starts), put(self.sizes, sizes.astype(np.int32)), np.concatenate((self.ids, ids)))
        self.used = used

    def encode(self, data: np.ndarray, cuts: np.ndarray, learn: Callable[[list[str]], tuple[list[int], list[int]]], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each segment) of the segments of data (UTF-8 bytes) between consecutive cuts.

        learn gives the ids of segments in one list and the number of each. whole marks segments that are not remembered.
        """
        count = len(cuts) - 1
        column = pa.LargeStringArray.from_buffers(count, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = column.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        raw = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        keys, checks = byte_hashes(raw, ends - ends[0])
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        self.used[at[known]] = True
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        values, new = self.ids, np.flatnonzero(~known)
        if len(new):
            ids, lengths = learn(distinct.take(pa.array(new)).to_pylist())
            ids, lengths = np.array(ids, dtype="<u4"), np.array(lengths, dtype=np.int64)
            starts[new], sizes[new] = len(values) + np.cumsum(lengths) - lengths, lengths
            values = np.concatenate((values, ids))
            fit = np.diff(ends)[new] <= LONGEST
            if whole is not None:
                fit &= ~np.isin(new, which[whole])
            _, first = np.unique(keys[new], return_index=True)  # two segments with one key by chance: neither is lost, one is remembered
            fit &= np.isin(np.arange(len(new)), first)
            if len(self.keys):
                fit &= self.keys[at[new]] != keys[new]
            keep = np.flatnonzero(fit)
            self._add(keys[new][keep], checks[new][keep], lengths[keep], gathered(ids, (np.cumsum(lengths) - lengths)[keep], lengths[keep]))
        made = sizes[which]
        return gathered(values, starts[which], made), made


class SegmentEncoder:
    """ids of whole texts, as tokenizers' encode(text, add_special_tokens=False) gives them.

    A text is cut where the tokenizer's pre-tokenizer always cuts, so segments encode independently: before white space
    that follows something else, and before the last space of a run of white space that something else follows. Texts with
    white space beyond ASCII, control characters or strings of special tokens are encoded whole. A segment of letters
    goes straight to the library's model, as the pre-tokenizer would leave it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.drops_space = any(s["type"] == "Split" and s["behavior"] == "Removed" for s in steps)
        if not self.drops_space and not (steps[0]["type"] == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and spec["normalizer"] is None):
            raise ValueError("segments of this tokenizer's texts may not be independent")
        if any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("unknown special tokens")
        self.size = self.tokenizer.get_vocab_size()
        single = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.stops = {x: single(x)[0] for x in _STOPS}
        self.newline = None if self.drops_space else single("\n")[0]
        self.memo = SegmentMemo()

    @classmethod
    def of(cls, name_or_path: str) -> "SegmentEncoder":
        path = name_or_path if os.path.isabs(name_or_path) else tokenizer_path(name_or_path)
        if path not in _LOADED:
            _LOADED.clear()  # a worker that goes on to another stage keeps one memo
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _learn(self, keys: list[str]) -> tuple[list[int], list[int]]:
        """Segments that are one pre-token of letters, perhaps with a stop behind, go to the model, the others to the library's whole chain."""
        heads = [k[:1] if k[:1] in " \n" else "" for k in keys]
        tails = [k[-1:] if k[-1:] in _STOPS else "" for k in keys]
        bodies = [k[len(h) : len(k) - len(t)] for k, h, t in zip(keys, heads, tails, strict=True)]
        shown = "\n".join([b if b.isalpha() else "" for b in bodies])
        if self.drops_space:
            shown = unicodedata.normalize("NFC", shown).lower()
            if not shown.isascii():  # beyond Latin, lower case may not go by single letters
                shown = "\n".join(["" if w and (max(w) >= "ɐ" or not w.isalpha()) else w for w in shown.split("\n")])
        words = shown.encode().decode("latin-1").translate(_BYTE_CHARACTERS | {10: "\n"}).split("\n")
        space = "" if self.drops_space else _BYTE_CHARACTERS[32]
        rest = [i for i, w in enumerate(words) if not w]
        encoded = self.tokenizer.encode_batch_fast([keys[i] for i in rest], add_special_tokens=False)
        others = {i: e.ids for i, e in zip(rest, encoded, strict=True)}
        tokenize, stops, newline = self.tokenizer.model.tokenize, self.stops, self.newline
        out: list[int] = []
        sizes: list[int] = []
        for i, (word, head, tail) in enumerate(zip(words, heads, tails, strict=True)):
            before = len(out)
            if not word:
                out += others[i]
            else:
                if head == "\n" and newline is not None:
                    out.append(newline)
                out += [t.id for t in tokenize(space + word if head == " " else word)]
                if tail:
                    out.append(stops[tail])
            sizes.append(len(out) - before)
        return out, sizes

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments begin, and which of them are whole texts."""
        texts = np.flatnonzero(np.diff(bounds))
        firsts, lasts = bounds[texts], bounds[texts + 1] - 1
        space = _SPACE[data]
        after = np.append(space[1:], True)
        after[lasts] = True
        cut = (data == 32) & ~after
        cut[1:] |= space[1:] & ~space[:-1]
        odd = [np.flatnonzero((data >= 28) & (data <= 31)), np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))]
        for first, seconds in _ODD_SPACE:
            at = np.flatnonzero(data[:-1] == first[0])
            odd.append(at[np.isin(data[at + 1], [s[0] for s in seconds])])
        uncut = np.unique(np.searchsorted(firsts, np.concatenate(odd), side="right") - 1)
        for i in uncut.tolist():
            cut[firsts[i] : lasts[i] + 1] = False
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, firsts[uncut])

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that lie one after another in data at bounds; each text's ids are followed by end if given."""
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        if len(data):
            starts, whole = self._cuts(data, bounds)
            ids, made = self.memo.encode(data, np.append(starts, len(data)), self._learn, whole)
            offsets = np.concatenate(([0], np.cumsum(made)))[np.searchsorted(starts, bounds)]
        else:
            ids, offsets = np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        if end is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
