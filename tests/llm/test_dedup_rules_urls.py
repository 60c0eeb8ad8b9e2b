"""Operators 1, 2, 3, 4, 6, 9 and the pipeline against plain Python, over whole tables and hard rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomgraph.llm import bin_packing, jaccard_join, line_dedup, quality_rules, queries, sentencepiece_codec, substring_dedup, url_filter
from loomgraph.llm.shared import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LINE = "one two three four five six seven eight nine ten"
HARD = [
    (5, None), (4, ""), (3, " \n\t "), (2, "A b"), (1, "a B"), (7, LINE), (8, LINE.upper()), (9, LINE + " eleven"), (None, LINE), (None, "alone here"), (10, "x " * 3000), (11, "x " * 3000), (11, "x " * 3000), (12, f"{LINE}\n{LINE}\nend"), (13, f"start\n{LINE}\n{LINE}\nend"),
    (14, f"{LINE}. Second sentence of some words that everyone copies around, again and again, all the time.\nown words"), (15, f"another start. {LINE}. Second sentence of some words that everyone copies around, again and again, all the time. tail é漢"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sid string")


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(rows, threshold=80):
    sets = [(d, shingles(t)) for d, t in rows]
    lists, parent = defaultdict(list), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x])
        for j, n in shared.items():
            if 100 * n >= threshold * (len(s) + len(sets[j][1]) - n):
                parent[root(i)] = root(j)
        for x in s:
            lists[x].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(s), min(least[root(i)], default=None)) for i, (d, s) in enumerate(sets))


def test_jaccard_hard_rows(spark):
    got = Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, HARD)).collect()))
    assert got == brute_components(HARD)
    assert jaccard_join.jaccard_components(docs_of(spark, [])).count() == 0


def test_jaccard_chains_and_hot_groups(spark):
    """Near copies whose pairs do not all link, short sets on both sides of the boundary and one line that most rows hold."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base, hot = [word() for _ in range(60)], [word() for _ in range(9)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(60)] = word()
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join([*hot, *(word() for _ in range(rng.randint(0, 6)))])) for i in range(120)]
    rows += [(400 + i, " ".join(base[: rng.randint(3, 14)])) for i in range(60)]
    got = Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows), hot_rows=16).collect()))
    assert got == brute_components(rows)


def test_jaccard_query(spark, sf_dir):
    got = Counter(tuple(r)[:3] for r in queries.op1_jaccard_join(spark, sf_dir).collect())
    assert got == brute_components(documents(spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == Counter(con.execute(jaccard_join.oracle()).fetchall())


def test_boundary_moves_with_cost():
    cheap, dear = [(n, 100, 10) for n in range(1, 20)], [(n, 100, 10**9) for n in range(1, 20)]
    assert jaccard_join.boundary(cheap, 80) < jaccard_join.boundary(dear, 80)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(7, 7), (-5, 300)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: root(x) for x in linked}


def counts(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = [*HARD, (20, "#*$ a|b <c> 😀 & %"), (21, ("a b c d e f g h i " * 2) + "z a b c d e f g h"), (22, "r " * 100)]
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, None), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r)[:8] for r in quality_rules.judge(docs_of(spark, rows), labels).collect())
    want = Counter()
    for d, t in rows:
        n = counts(t)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        want[(d, *n, failed, not failed)] += 1
    assert got == want
    assert quality_rules.judge(docs_of(spark, []), labels.limit(0)).count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    for k, n, p in ((0, 10, 0.1), (3, 400, 0.02), (7, 1000, 0.01), (40, 9000, 0.005)):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < 30 else got
        assert got == pytest.approx(want if k <= n * p else 1.0, rel=1e-9)


def test_cutoffs_hold_the_risk(spark):
    """The strictest cutoff that a test allows and that catches something; a small stratum and one with nothing to catch get none."""
    rows = [("big", 400 if i % 100 == 0 else 40, True) for i in range(6000)] + [("big", s, False) for s in (900, 480, 420, 70, 30)] + [("small", 0, True)] * 100 + [("small", 900, False)] * 50 + [("clean", -50, True)] * 500
    found = {r.stratum: r.cutoff for r in quality_rules.choose_cutoffs(spark.createDataFrame(rows, "stratum string, score long, good boolean")).collect()}
    assert found == {"big": 50}  # 0 would reject all; one in a hundred good ones goes


def test_score_finds_bad_documents(spark):
    """Documents labelled bad have many symbols: the score of symbols rises, and the cutoffs reject nearly all bad ones and few good ones."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(4000):
        bad = rng.random() < 0.2
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
        for _ in range(rng.randint(20, 40) if bad else rng.choice((0, 0, 1, 2))):
            words[rng.randrange(60)] += "#"
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - bad, 0))
    got = quality_rules.judge(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    bad = {d for d, q, _ in labels if not q}
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & bad) < 0.05 * len(bad) and len(kept - bad) > 0.98 * (len(rows) - len(bad))


def test_quality_oracle(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    assert sorted(map(tuple, queries.op2_quality_rules(spark, sf_dir).collect())) == sorted(con.execute(quality_rules.oracle()).fetchall())
    assert sorted(map(tuple, queries.op9_url_filter(spark, sf_dir).collect()), key=str) == sorted(con.execute(url_filter.oracle()).fetchall(), key=str)


def brute_chunks(rows):
    found = []
    for d, t in set(rows):
        if t:
            raw = t.encode()
            for a, b, n in line_dedup.chunk_bounds(raw):
                part = raw[a:b].rstrip(b"\n")
                if n >= 2 and part.strip():
                    found.append((part, (d is not None, d or 0, zlib.crc32(raw), a), d, a, b))
    first = {}
    for part, place, d, a, _ in sorted(found, key=lambda x: x[1]):
        first.setdefault(part, (place, d, a))
    return sorted(((d, a, b, *first[p][1:]) for p, place, d, a, b in found if place != first[p][0]), key=str)


def test_line_dedup(spark, sf_dir):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefg") for _ in range(4))
    shared = [line() for _ in range(30)]
    rows = [*HARD, *[(100 + i, "\n".join([*(line() for _ in range(rng.randint(0, 3))), *shared[rng.randint(0, 8) :], line()])) for i in range(25)]]
    df = docs_of(spark, rows)
    got = line_dedup.repeated_chunks(df).select("doc_id", "start", "end", "keeper_id", "keeper_start")
    want = brute_chunks(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 20
    cut = line_dedup.remove_chunks(df)
    assert cut.schema.names == df.schema.names
    spans = defaultdict(list)
    for d, a, b, *_ in want:
        spans[d].append((a, b))
    texts = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        for a, b in sorted(set(spans[d]), reverse=True):
            raw = raw[:a] + raw[b:] if len(raw) >= b else raw
        texts[d, None if t is None else raw.decode()] += 1
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == texts
    assert line_dedup.repeated_chunks(docs_of(spark, [])).count() == 0
    got = queries.op6_line_dedup(spark, sf_dir).select("doc_id", "start", "end", "keeper_id", "keeper_start")
    assert sorted(map(tuple, got.collect()), key=str) == brute_chunks(documents(spark, sf_dir))


def test_chunks_cover_the_text():
    for raw in (b"a", b"\n", b"a\nb\n", b"\n\nx", b"x\n" * 50):
        bounds = line_dedup.chunk_bounds(raw)
        assert b"".join(raw[a:b] for a, b, _ in bounds) == raw and sum(n for *_, n in bounds) == len(raw.rstrip(b"\n").split(b"\n")) + (len(raw) - len(raw.rstrip(b"\n")) - 1 if raw.endswith(b"\n") else 0)


def brute_spans(rows, least=substring_dedup.LEAST_WORDS):
    units = []
    for d, t in set(rows):
        raw = (t or "").encode()
        for no, (a, b) in enumerate(substring_dedup.units_of(raw) if raw else []):
            plain, words = substring_dedup.normalised(raw[a:b])
            if plain:
                units.append((plain, (d is not None, d or 0, zlib.crc32(raw), a), (d is not None, d or 0, zlib.crc32(raw)), no, a, b, words, d))
    first = {}
    for u in sorted(units, key=lambda u: u[1]):
        first.setdefault(u[0], u[1])
    out, run = [], []
    for u in [*sorted((u for u in units if first[u[0]] != u[1]), key=lambda u: (u[2], u[3])), None]:
        if run and (u is None or u[2] != run[-1][2] or u[3] != run[-1][3] + 1):
            if sum(x[6] for x in run) >= least:
                out.append((run[0][7], run[0][4], run[-1][5], len(run), sum(x[6] for x in run)))
            run = []
        if u:
            run.append(u)
    return sorted(out, key=str)


def test_substring_dedup(spark, sf_dir):
    columns = ("doc_id", "start", "end", "units", "words")
    df = docs_of(spark, HARD)
    got = sorted(map(tuple, substring_dedup.repeated_spans(df).select(*columns).collect()), key=str)
    assert got == brute_spans(HARD) and any(d == 15 for d, *_ in got)
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert cut[15].text == "another start. tail é漢" and cut[14].text == dict(HARD)[14] and cut[5].text is None and cut[15].sid == "clash"
    assert substring_dedup.repeated_spans(docs_of(spark, [])).count() == 0
    got = queries.op3_substring_dedup(spark, sf_dir).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == brute_spans(documents(spark, sf_dir))


def test_substring_dedup_across_blank_units(spark):
    """Runs go on over CRLF ends, blank lines and lone punctuation, whatever the kind of unit; words are not made of punctuation."""
    lines = [f"the shared line number {i} has eight words." for i in range(6)]
    for kind, ends in (("sentence", ["\r\n", " \n", ".. \r\n\r\n", "\n"]), ("line", ["\n", "\n\n", "\n...\n \n"])):
        rows = [(i, f"own start {i}{end}" + end.join(lines) + f"{end}own words {i}") for i, end in enumerate(ends)]
        got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, rows), kind=kind).collect()}
        assert got == {0: rows[0][1]} | {i: f"own start {i}{end}own words {i}" for i, end in enumerate(ends) if i}, kind
    dots = [(1, "short.\n" + "...\n" * 30 + "one"), (2, "short.\n" + "...\n" * 30 + "two")]
    assert substring_dedup.repeated_spans(docs_of(spark, dots)).count() == 0
    assert substring_dedup.units_of(b"\n\nfirst here.\r\nsecond. ... \n\n") == [(0, 2), (2, 15), (15, 29)]


def library():
    import sentencepiece

    from loomgraph.llm.tokens import tokenizer_path

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_the_library():
    pieces, lib, rng = sentencepiece_codec.Pieces.of("piece_bpe_32k.model"), library(), random.Random(3)
    parts = [*" eaotins  .,'\n\t漢字日本語テキストéèß0123", "▁", "<s>", "the ", "ing", "😀", "\x00", "==", "    ", "////", "中国"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [rng.choice("ae=/.-t ") * rng.randint(1, 40) + rng.choice("ae=/.-t ") * rng.randint(1, 40) for _ in range(300)] + ["a" * 3000, "=" * 2000, "international" * 300, "", None]
    for text in texts:
        ids = np.frombuffer(pieces.encode(text), "<i4").tolist()
        assert ids == lib.encode(text or ""), repr(text)
        assert pieces.decode(ids) == (text or "").replace("▁", " ")


def test_unigram_paths_are_best():
    """With scores of a unigram model the streaming search gives the best sum, as a search over the whole text does."""
    rng = random.Random(9)
    scores = {p: -rng.random() * 8 for p in {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(18)} | {"a", "b"}}
    pieces = sentencepiece_codec.Pieces({p: i for i, p in enumerate(scores)}, scores, [], 99, bpe=False)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max(best[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores)
        ids = pieces.segment(text)
        assert "".join(pieces.text_of[i] for i in ids) == text
        assert sum(scores[pieces.text_of[i]] for i in ids) == pytest.approx(best[-1])


def test_pieces_query(spark, sf_dir):
    lib = library()
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, sf_dir).collect()}
    for d, t in documents(spark, sf_dir):
        ids = lib.encode(t or "")
        assert (got[d].n_pieces, got[d].ids_crc32, got[d].same) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    hard = sentencepiece_codec.pieces_digest(docs_of(spark, HARD)).collect()
    assert len(hard) == len(HARD) and all(r.same for r in hard)
    assert sentencepiece_codec.pieces_digest(docs_of(spark, [])).count() == 0


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://A.Example.COM/en/x?y#z", link("far.org")), (2, "https://www.example.com/en/", link("good.org", "good.org")), (3, "http://x.net/es/1", None), (4, "http://x.net/de/1", link("good.org")), (5, "http://spam.org/", link("x.net")),
        (6, "http://spam.org/", link("x.net")), (7, None, None), (8, "no scheme", ""), (9, "http://good.org", ""), (10, "http://notexample.com?q=/en/", ""), (11, "ftp://u@h.com:80/EN/", ""), (12, "http://com/", ""), (12, "http://com/", ""),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = Counter(map(tuple, url_filter.filter_urls(df).collect()))
    want = Counter([
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "x.net", "/es/1", "net/es/", "block"), (4, "x.net", "/de/1", None, "block"), (5, "spam.org", "/", None, "block"),
        (6, "spam.org", "/", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "good.org", "", None, "allow"), (10, "notexample.com", "", None, "allow"), (11, "u@h.com:80", "/EN/", None, "allow"), (12, "com", "/", "com/", "allow"), (12, "com", "/", "com/", "allow"),
    ])
    assert got == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_pagerank(spark):
    """Scores against a plain power iteration."""
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e")]
    seeds = spark.createDataFrame([("a", 0.7, 0.0), ("d", 0.3, 0.0), ("e", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(seeds, spark.createDataFrame(edges, "src string, dst string"), rounds=30).collect()}
    for column, start, links in ((0, {"a": 0.7, "d": 0.3}, edges), (1, {"e": 1.0}, [(b, a) for a, b in edges])):
        score = {h: 0.15 * start.get(h, 0) for h in "abcde"}
        for _ in range(30):
            score = {h: 0.15 * start.get(h, 0) + 0.85 * sum(score[s] / sum(x == s for x, _ in links) for s, t in links if t == h) for h in "abcde"}
        for h in "abcde":
            assert got.get(h, (0, 0))[column] == pytest.approx(score[h], abs=1e-6)


def test_url_verdicts_do_not_depend_on_other_hosts(spark):
    """One link pattern alone and among two million pages that are allowed or blocked and have no links to it."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pattern = [("http://bad.net/es/1", "")] + [(f"http://linker{i}.org/", link("bad.net")) for i in range(100)]
    pattern += [("http://both.org/", link("bad.net")), ("http://site.com/", link("both.org", "other.org")), ("http://last.org/", link("linker7.org"))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pattern)], "page_id long, url string, html string")
    rest = spark.range(2_000_000).selectExpr("id + 1000 as page_id", "concat('http://h', id % 1000, if(id % 5 > 0, '.net/fr/', '.com/')) as url", "'' as html")
    want = ["block"] * 101 + ["allow", "allow", "block"]  # half of a good page's trust is more than both.org's part of the distrust
    assert [r.verdict for r in url_filter.filter_urls(df).orderBy("page_id").collect()] == want
    assert [r.verdict for r in url_filter.filter_urls(df.union(rest)).where("page_id < 1000").orderBy("page_id").collect()] == want


def test_pipeline_knows_rows_by_id_and_text(spark, sf_dir):
    """Repeated rows, null ids and one id with two texts in the stages that take rows away."""
    words = lambda tag: " ".join(f"{tag}word{i}" for i in range(40))
    near = words("b") + " end"
    rows = [(1, words("a")), (1, words("a")), (None, words("a")), (2, words("b")), (3, near), (3, words("c")), (None, words("d")), (None, words("d") + " end"), (None, words("e")), (4, "short"), (4, words("f")), (None, "short"), (None, None)]
    docs = docs_of(spark, rows)
    good = Counter((d, t) for d, t in rows if t and t != "short")
    after = corpus_pipeline.quality(spark, docs, sf_dir)
    assert after.columns == docs.columns and Counter((r.doc_id, r.text) for r in after.collect()) == good
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, list(good.elements())), sf_dir).collect())
    d = next(k for k in kept if k[1] and k[1].startswith("dword"))
    assert kept == Counter([(1, words("a")), (2, words("b")), (3, words("c")), d, (None, words("e")), (4, words("f"))])


def test_pipeline(spark, sf_dir):
    """Every stage against plain Python on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.save(stage(spark, docs, sf_dir), "stage")
        if name == "best-fit packing":
            assert len({r.sequence_id for r in docs.collect()}) <= bin_packing.lower_bound(Counter(r.length for r in docs.collect()), 4096) + 1
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in before}
            break
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality rules":
            kept = {r.doc_id for r in queries.op2_quality_rules(spark, sf_dir).collect() if r.kept}
            assert after == {d: t for d, t in before if d in kept}
        elif name == "n-gram Jaccard join":
            assert set(after) == {d for d, _, c in brute_components(before) if d == c}
        else:
            spans = defaultdict(list)
            for d, a, b, *_ in brute_chunks(before) if name == "line dedup" else brute_spans(before):
                spans[d].append((a, b))
            for d, t in before:
                raw = t.encode()
                for a, b in sorted(spans[d], reverse=True):
                    raw = raw[:a] + raw[b:]
                assert after[d] == raw.decode()


def test_jaccard_light_side_links_distinct_sets(spark):
    """Short texts that near copies make dear to verify: the boundary leaves sets of 4, 5 and 6 shingles to the enumeration, which links them."""
    rng = random.Random(6)
    rows = []
    for i in range(0, 400, 2):
        words = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(9)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words, "tail"]))]
    same = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(9)]
    rows += [(1000 + i, " ".join([*same, f"own{i}"])) for i in range(50)] + [(999, " ".join(same))]
    stats = [(n, 100, 100 * (jaccard_join._prefix(n, 80) + jaccard_join.VERIFYING)) for n in (4, 5, 6)]
    assert jaccard_join.boundary(stats, 80) >= 6
    verified = []
    held, jaccard_join._verify = jaccard_join._verify, lambda docs, sets, pairs, *more: verified.append(pairs.count()) or held(docs, sets, pairs, *more)
    try:
        got = Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, [(d, t) for d, t in rows if d >= 999])).collect()))
    finally:
        jaccard_join._verify = held
    assert got == brute_components([(d, t) for d, t in rows if d >= 999]) and len({c for *_, c in got}) == 1
    assert sum(verified) == 0
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows)).collect())) == brute_components(rows)


def test_bitmaps_drop_no_linked_pair():
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 5, 63, 64, 65, 200, 513, 2000, 5000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for part in (1.0, 0.95, 0.9, 0.8, 0.6, 0.3, 0.0):
            for more in (0, n // 9, n // 4, n):
                y = np.concatenate([x[: int(part * n)], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
                if len(y):
                    rows.append((x, y, 100 * int(part * n) >= 80 * (n + len(y) - int(part * n))))
    marks = [[jaccard_join._bitmap(r[side]) for r in rows] for side in (0, 1)]
    columns = [pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array([len(r[0]) for r in rows]), pa.array([len(r[1]) for r in rows]), *(pa.array(m, pa.binary()) for m in marks)]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "m", "bits", "marks"])
    kept = set(next(iter(jaccard_join._near(80)([batch]))).column(0).to_pylist())
    linked = {i for i, r in enumerate(rows) if r[2]}
    assert linked and linked <= kept
    assert not any(i in kept for i, (x, y, _) in enumerate(rows) if len(x) >= 200 and 0.8 * len(x) <= len(y) <= 1.25 * len(x) and not np.isin(x, y).any())
