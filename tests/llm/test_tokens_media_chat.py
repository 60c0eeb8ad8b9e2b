"""Operators 5, 7, 8 and 10 against plain Python over whole tables and hard rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import bin_packing, chat_format, media_ts, queries, token_files
from loomgraph.llm.shared import text_slices
from loomgraph.llm.tokens import SegmentEncoder, SegmentMemo, tokenizer_path

HARD = [
    (3, None), (1, ""), (2, "a  b\n \nc"), (2, "a  b\n \nc"), (None, "<|endoftext|> x"), (9, "word " * 9000), (8, "one\ntwo. Three, é́ 漢"), (8, "tie"), (7, "   "),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], "doc_id long, text string, length string, n_tokens string")


def encoded(name, text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_encode_as_whole_texts(name):
    rng = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\t", "a", "Word", "é", "É", "12", "!", ".", ",", "́", "漢", "'s", "<|endoftext|>", "Σ", "\x1c", "\r", "\x01", "İ", "ª"]
    parts += [" ", "\u3000", "\u2028", "\x85", "...", "don't", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(9000)]
    encoder = SegmentEncoder(tokenizer_path(name))
    encoder.memo = SegmentMemo(500, 2000)  # it has to forget again and again
    for first, data, bounds in text_slices(pa.array(texts), 1 << 12):
        ids, offsets = encoder.encode(data, bounds)
        ended, more = encoder.encode(data, bounds, 7)
        assert len(encoder.memo.keys) <= 500 and len(encoder.memo.ids) <= 2000
        for i in range(len(bounds) - 1):
            want = encoder.tokenizer.encode(texts[first + i], add_special_tokens=False).ids
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, repr(texts[first + i])
            assert ended[more[i] : more[i + 1]].tolist() == [*want, 7]


def test_variable_length_ids_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        assert token_files.unpack_ids(*token_files.pack_ids(ranks), n).tolist() == ranks.tolist()


def test_token_files(spark, tmp_path):
    want, before = [], 0
    for d, t in sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encoded("byte_bpe_50k.json", t, 0)
        want.append((d, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    got = token_files.token_digest(docs_of(spark, HARD), block_ids=50, shards=3).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_digest(docs_of(spark, [])).count() == 0
    token_files.write_tokens(docs_of(spark, HARD), str(tmp_path / "t"), block_ids=50)
    read = Counter((r.doc_id, bytes(r.ids)) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    assert read == Counter((d, np.array(encoded("byte_bpe_50k.json", t, 0), "<u4").tobytes()) for d, t in HARD)


def test_packing_hard_rows(spark):
    rows = bin_packing.pack_documents(docs_of(spark, HARD), capacity=64).collect()
    check_packing([(d, t) for d, t in HARD], rows, 64)
    assert bin_packing.pack_documents(docs_of(spark, [])).count() == 0


def check_packing(docs, rows, capacity):
    want = Counter()
    for d, t in docs:
        ids = encoded("word_bpe_49k.json", t, 1)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[d, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query_meets_the_lower_bound(spark, sf_dir):
    rows = queries.op8_bin_packing(spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    used = check_packing(docs, rows, 4096)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def test_bin_completion_is_optimal_on_small_cases():
    for trial in range(120):
        rng = random.Random(trial)
        capacity = rng.choice([10, 20, 50, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 12)))
        patterns = bin_packing.complete_bins(dict(counts), capacity)
        got = Counter()
        for times, items in patterns:
            assert sum(items) <= capacity
            for n in items:
                got[n] += times
        assert got == counts
        items = sorted(counts.elements(), reverse=True)
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for room in sorted({r for r in rooms if r >= items[i]}):
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        assert bin_packing.bins(patterns) == best[0]


def test_search_improves_on_best_fit_decreasing():
    """Pieces of a quarter to a half of a bin, where best fit pairs what should go in threes; many pieces share lengths or none do."""
    rng = random.Random(1)
    counts = Counter(rng.randint(1100, 2100) for _ in range(300))
    packed = bin_packing.complete_bins(dict(counts), 4096)
    assert bin_packing.bins(packed) < bin_packing.bins(bin_packing.best_fit_decreasing(dict(counts), 4096))
    assert sum((Counter({n: t * items.count(n) for n in items}) for t, items in packed), Counter()) == counts
    many = {45: 3000, 40: 3000, 35: 3000, 33: 3000, 30: 3000, 27: 3000}
    assert bin_packing.bins(bin_packing.complete_bins(many, 100)) < bin_packing.bins(bin_packing.best_fit_decreasing(many, 100))


def test_transport_stream_round_trip():
    rng = random.Random(2)
    for n in [0, 1, 192, 12287, 12288, 12289, 100_000, *(rng.randint(0, 30_000) for _ in range(20))]:
        payload = media_ts.padded(os.urandom(n))
        media = media_ts.mux(payload)
        read = media_ts.demux(media)
        assert len(payload) % 192 == 0 and len(media) % 188 == 0
        assert read["payload"] == payload and not read["errors"]
        assert read["pts"] == [i * 3600 for i in range(-(-len(payload) // media_ts.UNIT))]
        assert read["random_access"] == list(range(0, len(read["pts"]), media_ts.INTERVAL))


def test_lost_packets_are_seen():
    media = media_ts.mux(media_ts.padded(os.urandom(50_000)))
    assert media_ts.demux(media[: 188 * 9] + media[188 * 10 :])["errors"]["continuity"] == 1
    assert media_ts.demux(media[:-5])["errors"]["cut"] == 1
    assert media_ts.demux(b"\x00" + media[1:])["errors"]["sync"] == 1


def test_media_digest(spark):
    got = {(r.doc_id, r.n_bytes): r for r in media_ts.media_digest(docs_of(spark, HARD)).collect()}
    for d, t in HARD:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media_ts.mux(payload)).hexdigest() and r.media_bytes % 188 == 0


CHATS = [
    (1, 0, "user", "a<|end|>b\\<|text|>"), (1, 1, "assistant", "\n x <|turn|>\\|é漢"), (1, 1, "assistant", ""), (1, None, None, None), (2, 5, "assistant", "only <"), (2, 6, "assistant", "|end|> two"),
    (None, 0, "user", "q"), (3, 0, "assistant", "😀" * 50), (3, 1, "user", "\\\\<\\|"), (3, 2, "assistant", "z"), (3, 2, "assistant", "z"),
]


def check_chats(rows, got):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append((n is not None, n or 0, role or "", text or ""))
    assert len(got) == len(turns)
    for r in got:
        said = [(a, b) for *_, a, b in sorted(turns[r.conv_id])]
        loss = "".join(b for a, b in said if a == "assistant")
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_hard_rows(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    check_chats(CHATS, chat_format.formatted_digest(chat_format.format_conversations(df)).collect())
    assert chat_format.formatted_digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    got = queries.op5_chat_format(spark, sf_dir).collect()
    check_chats([*rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)], got)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(chat_format.oracle()).fetchall())


def test_token_files_query(spark, sf_dir):
    """Every document of the table against the library's ids, in order of doc_id."""
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    before, want = 0, []
    for d, t in docs:
        ids = encoded("byte_bpe_50k.json", t, 0)
        want.append((d, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted(map(tuple, queries.op7_token_files(spark, sf_dir).collect())) == want


def test_media_query(spark, sf_dir):
    """Every document's payload, by the columns of the contract; the stored bytes are read here by a reader of a few lines."""
    got = {r.doc_id: r for r in queries.op10_media_ts(spark, sf_dir).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(docs)
    for d, t in docs:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    media = media_ts.mux(payload)
    units: list[bytes] = []
    for at in range(2 * 188, len(media), 188):
        packet = media[at : at + 188]
        body = packet[4 + (1 + packet[4] if packet[3] & 0x20 else 0) :]
        units += [body] if packet[1] & 0x40 else []
        units[-1] += b"" if packet[1] & 0x40 else body
    assert b"".join(u[14:] for u in units) == payload
    assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_media_empty_table(spark):
    assert media_ts.media_digest(docs_of(spark, [])).count() == 0
