"""N-gram Jaccard join: a size-aware heavy-light join over word-shingle sets, grouped into connected components.

Sets A and B link when 100 * |A n B| >= threshold * |A u B|, that is when they share at least
need(|A|, |B|) = ceil(threshold * (|A| + |B|) / (100 + threshold)) shingles.

* Light side: for sets of at most x shingles, every subset of need(n, m) shingles is enumerated for every size class
  (n, m) with n, m <= x; two sets link exactly when they share such a subset, so groups of equal subsets are linked as
  stars and nothing has to be verified.
* Heavy side: every larger set (and each light set that a larger one could reach) puts its least frequent
  n - ceil(threshold * n / 100) + 1 shingles into inverted lists. Each list is scanned as a star around its most central
  member, which is then done in that list, and lists that still hold several components again around another one. Then
  what is left is scanned once: of every pair of members of different components that the size and position bounds
  allow, the smaller one is looked up by size class. So pairs inside a component are never made, and a list with one
  large component costs its length times the rest. Bitmaps of the sets, whose distance is at most that of the sets,
  drop most pairs that don't link before any text is fetched; every other pair is verified on whole texts.
* The boundary x is the size where enumeration starts to cost more than the scans with their verification (boundary()).

Shingle order: any order makes the prefix bound exact. The one used puts shingles of a table of the at most
`hot_rows` most frequent ones (a proven size, so it is broadcast) last by frequency, the rest first by hash. Lists of the
shingles in that table are dealt out over `SALTS` tasks when lists are gathered; any other shingle is rarer than those.
Exact copies share a set id and are one row per task before anything is shuffled.

Defined cases: null or wordless texts have the empty set, link with nothing and form their own component; repeated
rows and copies share a component; a row whose doc_id is null joins components as any other but never names one, so
where all ids are null component_id is null. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import connected_components, forget, mix, save, shingle_sets

MOST_LIGHT = 24  # sizes up to this one are weighed for enumeration
LOCAL_LEAST = 4  # a chunk of a task reports shingles of at least so many of its sets
CHUNK = 4_000_000  # shingles counted at a time in a task
MOST_SEEN = 1 << 20  # set ids that a task remembers so as to report copies once
SALTS = 64  # tasks for a frequent shingle's list
BITS = 2048  # most bits of a bitmap in the last scan
VERIFYING = 16  # what verifying a pair costs, in rows of an inverted list


def need(n: int, m: int, threshold: int):
    """Least overlap of linked sets of n and m shingles; also for arrays."""
    return -(-threshold * (n + m) // (100 + threshold))


def _light_classes(n: int, threshold: int, most: int) -> list[tuple[int, int, int]]:
    """Size classes (smaller, larger, overlap) that a set of n shingles takes part in."""
    low, high = -(-threshold * n // 100), 100 * n // threshold
    return [(min(n, m), max(n, m), int(need(n, m, threshold))) for m in range(max(1, low), min(high, most) + 1)]


def _bitmap(tokens: np.ndarray) -> bytes:
    """For each of a power of two of classes of shingles, as many as shingles or more, whether the set has an odd number of them.

    Two sets differ in at least as many shingles as their bitmaps do in bits, also when the longer one is folded.
    """
    size = 64 << (len(tokens) - 1 >> 6).bit_length()
    return np.packbits(np.bincount((mix(tokens) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def _survey(k: int):
    """Task: rows of documents (kind 0) and of locally frequent shingles (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("blob", pa.binary()), ("bits", pa.binary())])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        tokens, counts = tokens[counts >= LOCAL_LEAST].view(np.int64), counts[counts >= LOCAL_LEAST]
        size = len(tokens)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(size, np.int32)), pa.array(tokens), pa.array(counts.astype(np.int64)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary())], schema=schema)

    def run(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            sid, check, n, blob, bits = [], [], [], [], []
            for _, tokens in shingle_sets(batch.column(1), k):
                raw = tokens.tobytes()
                digest = xxhash.xxh3_128_intdigest(raw)
                sid.append((digest >> 65) - (1 << 62))
                check.append((digest & (2**64 - 1)) - (1 << 63))
                n.append(len(tokens))
                blob.append(raw if 0 < len(tokens) <= MOST_LIGHT else None)
                bits.append(None)
                if len(tokens) and sid[-1] not in seen:
                    bits[-1] = _bitmap(tokens)
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(sid[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size >= CHUNK:
                        yield counted(held)
                        held, size = [], 0
            crc = [xxhash.xxh64_intdigest(x.as_buffer(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(x.as_buffer(), 42) >> 63) if x.is_valid else 42 for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0).cast(pa.int64()), pa.array(sid, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(blob, pa.binary()), pa.array(bits, pa.binary())], schema=schema)
        if held:
            yield counted(held)

    return run


def _ordered(tokens: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the global order, with their frequencies as far as they are known."""
    keys, counts = hot
    if not len(keys):
        return tokens, np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    known = np.where(keys[at] == tokens, counts[at], 0)
    order = np.argsort(known, kind="stable")
    return tokens[order], known[order]


def _prefix(n: int, threshold: int) -> int:
    return n + threshold * n // -100 + 1


def _postings(k: int, threshold: int, light: int, hot):
    """Task: (token, salt, sid, n, pos, score) for the prefixes of heavy sets, once for each set id of the task."""

    def run(batches):
        seen = set()
        for batch in batches:
            out = [[], [], [], [], [], []]
            for _, tokens in shingle_sets(batch.column(0), k):
                n = len(tokens)
                if not n or 100 * n // threshold <= light:
                    continue
                sid = (xxhash.xxh3_128_intdigest(tokens.tobytes()) >> 65) - (1 << 62)
                if sid in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(sid)
                tokens, known = _ordered(tokens, hot.value)
                size = _prefix(n, threshold)
                out[0].append(tokens[:size].view(np.int64))
                out[1].append(np.where(known[:size] > 0, sid % SALTS, -1).astype(np.int32))
                out[2].append(np.full(size, sid, np.int64))
                out[3].append(np.full(size, n, np.int32))
                out[4].append(np.arange(size, dtype=np.int32))
                out[5].append(np.full(size, min(int(known.mean() * 16), 2**31 - 1), np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "salt", "sid", "n", "pos", "score"])

    return run


def _scan_costs(threshold: int, hot):
    """Task: for each light set, its size and the cost of its rows in inverted lists and of verifying it where others share them."""

    def run(batches):
        for batch in batches:
            n, cost = [], []
            for raw in batch.column(0).to_pylist():
                tokens, known = _ordered(np.frombuffer(raw, np.uint64), hot.value)
                size = _prefix(len(tokens), threshold)
                n.append(len(tokens))
                cost.append(size + VERIFYING * bool((known[:size] > 0).any()))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(cost, pa.int64())], names=["n", "cost"])

    return run


def boundary(stats: list[tuple[int, int, int]], threshold: int) -> int:
    """The largest light size: stats has (size, sets, scan cost) for each size up to MOST_LIGHT."""
    by = {n: (sets, cost) for n, sets, cost in stats}
    best, at = None, 0
    for x in range(MOST_LIGHT + 1):
        enumerated = sum(s * sum(comb(n, c) for *_, c in _light_classes(n, threshold, x)) for n, (s, _) in by.items() if n <= x)
        scanned = sum(c for n, (_, c) in by.items() if n > x)
        if best is None or enumerated + scanned <= best:
            best, at = enumerated + scanned, x
    return at


def _subsets(threshold: int, light: int):
    """Task: (key, low, n, sid) for every fixed-size subset of every light set."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for sid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = mix(np.frombuffer(raw, np.uint64))
                n = len(tokens)
                for low, high, c in _light_classes(n, threshold, light):
                    chosen = np.array(list(combinations(range(n), c)))
                    keys = mix(tokens[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(low * 1009 + high))
                    out[0].append(keys.view(np.int64))
                    out[1].append(np.full(len(keys), low, np.int32))
                    out[2].append(np.full(len(keys), n, np.int32))
                    out[3].append(np.full(len(keys), sid, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "low", "n", "sid"])

    return run


def _verified(k: int, threshold: int):
    """Task: pairs (a, b) of those with texts (a, text_a, b, text_b) that link."""

    def run(batches):
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 2)]
            sets: list[dict[int, np.ndarray]] = [{}, {}]
            for side in (0, 1):
                rows = list({x: i for i, x in enumerate(ids[side])}.values())
                for row, tokens in shingle_sets(batch.column(2 * side + 1).take(pa.array(rows, pa.int64())), k):
                    sets[side][ids[side][rows[row]]] = tokens
            keep = []
            for a, b in zip(*ids, strict=True):
                x, y = sets[0][a], sets[1][b]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                shared = int((x[at] == y).sum())
                keep.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep))], names=["a", "b"])

    return run


def _bounded(threshold: int, n: str, m: str, i: str, j: str, light: int):
    """The size and position bounds as a condition; pairs of two light sets belong to the enumeration."""
    least = f"ceil({threshold} * ({n} + {m}) / {100 + threshold}.0D)"
    return F.expr(f"100 * least({n}, {m}) >= {threshold} * greatest({n}, {m}) and greatest({n}, {m}) > {light} and 1 + least({n} - 1 - {i}, {m} - 1 - {j}) >= {least}")


def _with_roots(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    """df with the component of its sid, which is sid itself where no link names it."""
    if roots is None:
        return df.withColumn("root", F.col("sid"))
    return df.join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node")


def _joined_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Rows (node, root) after links (a, b) join components: only the components that new links name are looked at."""
    if roots is None:
        return connected_components(links)
    ends = links
    for end in ("a", "b"):
        ends = _with_roots(ends.withColumnRenamed(end, "sid"), roots).drop("sid").withColumnRenamed("root", end)
    up = save(connected_components(ends).select(F.col("node").alias("was"), F.col("root").alias("top")), "roots")
    moved = roots.join(up, roots["root"] == up["was"], "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = up.join(roots, up["was"] == roots["node"], "left_anti").select(F.col("was").alias("node"), F.col("top").alias("root"))
    return save(moved.union(fresh), "roots")


def _first_stars(postings: DataFrame) -> DataFrame:
    """The rows of lists with two or more sets, each with its list's most central member (hub) and number of sets.

    A frequent shingle's list is dealt out, so here it counts as several, each with a hub of its own.
    """
    whole = Window.partitionBy("token", "salt")
    once = postings.withColumn("before", F.lag("sid").over(whole.orderBy("sid"))).where("before is null or before <> sid")
    counted = once.withColumn("sets", F.count("*").over(whole)).where("salt >= 0 or sets > 1")
    return counted.withColumn("hub", F.max(F.struct("score", "sid", "n", "pos")).over(whole)).select("token", "salt", "sid", "n", "pos", "score", "hub", "sets")


def _star_pairs(lists: DataFrame, threshold: int, light: int, turn: int) -> DataFrame:
    """Rows (token, sid, hub, and whether to compare them) of each list around its most central member or, in
    even turns, that of a component that differs from list to list."""
    order = F.struct("score", "sid") if turn % 2 else F.struct(F.xxhash64("root", "token"), "score", "sid")
    hubs = lists.groupBy("token").agg(F.max_by(F.struct("sid", "n", "pos", "root"), order).alias("h"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    hubs = hubs.select("token", F.col("h.sid").alias("b"), F.col("h.n").alias("m"), F.col("h.pos").alias("at"), F.col("h.root").alias("top"))
    return lists.join(hubs, "token").withColumn("meet", F.expr("root <> top") & _bounded(threshold, "n", "m", "pos", "at", light))


def _near(threshold: int):
    """Task: of the pairs (a, b) with sizes and bitmaps those that differ in no more bits than linked sets can."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                folded = np.bitwise_xor.reduce(np.frombuffer(x + y, np.uint64).reshape(-1, min(len(x), len(y)) // 8), axis=0)
                keep.append(int(np.bitwise_count(folded).sum()) <= n + m - 2 * need(n, m, threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_pairs(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of set ids that the sets' bitmaps allow."""
    few = F.broadcast(pairs) if pairs.count() <= MOST_BROADCAST else pairs
    one = sets.select(F.col("sid").alias("a"), "n", "bits").join(few, "a")
    both = one.join(sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("marks")), "b")
    return save(both.select("a", "b", "n", "m", "bits", "marks").mapInArrow(_near(threshold), "a long, b long"), "near")


def _size_classes(threshold: int):
    """Task: (sid, class, own, bits) from (sid, n, bits): a set's own size class and the next two, each with the bitmap folded
    to the width that all sets have which meet in that class."""
    base = max(100 / threshold, 1.05)

    def run(batches):
        for batch in batches:
            sid, classes, own, bits = [], [], [], []
            for s, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = int(log(n) / log(base))
                for c in range(first, first + 3):
                    least = max(1, int(base ** (c - 2)) - 1)
                    width = min(BITS // 64, 1 << (least - 1 >> 6).bit_length())
                    sid.append(s)
                    classes.append(c)
                    own.append(c == first)
                    bits.append(np.bitwise_xor.reduce(np.frombuffer(raw, np.int64).reshape(-1, width), axis=0))
            ends = np.cumsum([0, *map(len, bits)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *bits])))
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(classes, pa.int32()), pa.array(own, pa.bool_()), words], names=["sid", "class", "own", "bits"])

    return run


def _rest_pairs(lists: DataFrame, classes: DataFrame, threshold: int, light: int) -> DataFrame:
    """Pairs (a, b) of members of one list, but of different components, that the bounds allow; b is the smaller set.

    In a pair the smaller set has the shingle among its first n - need(n, n) + 1, and its size class is the larger one's
    or the one below. Members of a list's largest component are paired with the others only. Two sets differ in at least
    as many shingles as their bitmaps do in bits, which leaves few pairs that don't link.
    """
    rows = lists.withColumn("main", F.expr("root = most"))
    large = rows.join(classes.where("own"), "sid").select("token", F.col("sid").alias("a"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("top"), F.col("bits").alias("marks"), "main", "class")
    small = rows.where(f"n - pos >= ceil({2 * threshold} * n / {100 + threshold}.0D)").join(classes, "sid")
    small = small.select("token", F.col("sid").alias("b"), "n", "pos", "root", "bits", F.col("main").alias("is_main"), "class")
    differ = " + ".join(f"coalesce(bit_count(get(bits, {i}) ^ get(marks, {i})), 0)" for i in range(BITS // 64))
    close = F.expr(f"{differ} <= n + m - 2 * ceil({threshold} * (n + m) / {100 + threshold}.0D)")
    found = lambda x, y: x.join(y, ["token", "class"]).where(F.expr("root <> top and (m > n or (m = n and a > b))") & _bounded(threshold, "n", "m", "pos", "at", light) & close).select("a", "b")
    return found(small.where("not is_main"), large).union(found(small.where("is_main"), large.where("not main"))).distinct()


def _mixed(lists: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with the largest one (most)."""
    sizes = lists.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token")
    return lists.join(sizes.agg(F.max_by("root", "c").alias("most"), F.count("*").alias("roots")).where("roots > 1").drop("roots"), "token")


def jaccard_components(
    docs: DataFrame, k: int = 5, threshold: int = 80, hot_rows: int = 1 << 18, star_rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", with_roots: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    With with_roots also text_hash (xxhash64 of the text) and root, which names the component where ids are null (null for wordless texts).
    star_rounds changes what is scanned first, never the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = save(docs.mapInArrow(_survey(k), "kind int, a long, b long, c long, n long, crc long, blob binary, bits binary"), "survey")
    members = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), F.col("c").alias("check"), "n", "crc", "blob", "bits")

    # the bounded table of frequent shingles
    counts = save(survey.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("f")).withColumn("bin", F.floor(F.log2("f") * 8)), "frequent")
    least, total = 1 << 62, 0
    for row in sorted(counts.groupBy("bin").count().collect(), reverse=True):  # at most 8 * 63 bins
        total += row["count"]
        if total > hot_rows:
            break
        least = row["bin"]
    table = counts.where(F.col("bin") >= least).select("token", "f").toPandas()  # at most hot_rows rows
    keys = table["token"].to_numpy(np.int64).view(np.uint64)
    hot = spark.sparkContext.broadcast((np.sort(keys), table["f"].to_numpy(np.int64)[np.argsort(keys)]))

    # sets: one row per distinct set; two hashes guard against sets that share an id by chance
    sets = save(members.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "crc")).alias("copy"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("blob").alias("blob"), F.first("bits", ignorenulls=True).alias("bits"), (F.min("check") == F.max("check")).alias("same")), "sets")
    if sets.where("not same").limit(1).count():
        raise RuntimeError("two different sets share a 63-bit id")

    small = sets.where("blob is not null")
    stats = small.select("blob").mapInArrow(_scan_costs(threshold, hot), "n long, cost long").groupBy("n").agg(F.count("*").alias("sets"), F.sum("cost").alias("cost"))
    light = boundary([tuple(r) for r in stats.collect()], threshold)  # at most MOST_LIGHT rows
    scratch = [survey, counts, sets]

    # light side
    subsets = save(small.where(F.col("n") <= light).select("sid", "blob").mapInArrow(_subsets(threshold, light), "key long, low int, n int, sid long"), "subsets")
    hubs = subsets.groupBy("key", "low").agg(F.min(F.struct("n", "sid")).alias("hub")).where("hub.n = low")
    stars = subsets.join(hubs, ["key", "low"]).where("hub.sid <> sid").select(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).distinct()
    stars = save(stars, "stars")
    roots = None if stars.isEmpty() else _joined_components(None, stars)
    scratch += [subsets, stars]

    # heavy side: every list around its most central member; after that, lists of two are done, and so is that member
    postings = docs.select("text").mapInArrow(_postings(k, threshold, light, hot), "token long, salt int, sid long, n int, pos int, score int")
    lists = save(_first_stars(postings), "lists")
    pairs = lists.where("sid <> hub.sid").where(_bounded(threshold, "n", "hub.n", "pos", "hub.pos", light)).select(F.col("sid").alias("a"), F.col("hub.sid").alias("b"))
    pairs = save(pairs.distinct(), "pairs")
    tried, left = pairs, lists.where("salt >= 0 or (sets > 2 and sid <> hub.sid)").select("token", "sid", "n", "pos", "score")
    scratch += [lists, pairs]
    for turn in range(1, star_rounds + 2):
        links = _verify(docs, sets, pairs, k, threshold, scratch)
        if not links.isEmpty():
            roots = _joined_components(roots, links)
        apart = save(_with_roots(left.drop("root"), roots), "apart")
        scratch.append(apart)
        last = turn > star_rounds
        if last:
            mixed = save(_mixed(apart), "mixed")
            marked = sets.select("sid", F.col("n").cast("long").alias("n"), "bits").join(mixed.select("sid").distinct(), "sid", "left_semi")
            classes = save(marked.mapInArrow(_size_classes(threshold), "sid long, class int, own boolean, bits array<long>"), "classes")
            scratch += [mixed, classes]
            pairs = _rest_pairs(mixed, classes, threshold, light)
        else:
            around = save(_star_pairs(apart, threshold, light, turn), "stars")
            scratch.append(around)
            pairs = around.where("meet").select(F.col("sid").alias("a"), "b").distinct()
            left = around.where("sid <> b").select("token", "sid", "n", "pos", "score")
        pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        scratch.append(pairs)
        tried = tried.union(pairs)
    links = _verify(docs, sets, pairs, k, threshold, scratch)
    if not links.isEmpty():
        roots = _joined_components(roots, links)

    named = save(_with_roots(sets.select("sid", "doc_id"), roots), "named")
    least_id = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least_id, "root").select("sid", "component_id", "root")
    linked = members.where("n > 0").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("crc").alias("text_hash"), "root")
    found = linked.union(members.where("n = 0").select("doc_id", "n", "doc_id", "crc", F.lit(None).cast("long")))
    result = save(found if with_roots else found.drop("text_hash", "root"), "components")
    for table in scratch:
        forget(table)
    return result


#: Up to so many wanted sets (24 bytes each) or pairs are broadcast to meet texts without a shuffle; more are joined by key.
MOST_BROADCAST = 250_000


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, int]:
    """Rows (sid, text) for the distinct set ids in wanted, several where rows share id and text, and the number of ids."""
    ids = save(sets.join(wanted, "sid", "left_semi").select("sid", F.col("copy.doc_id").alias("id"), F.col("copy.crc").alias("hash")), "wanted")
    scratch.append(ids)
    number = ids.count()
    few = F.broadcast(ids) if number <= MOST_BROADCAST else ids
    return docs.withColumn("crc", F.xxhash64("text")).join(few, F.expr("doc_id <=> id and crc = hash")).select("sid", "text"), number


def _verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, threshold: int, scratch: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) of set ids whose texts link. Up to MOST_BROADCAST pairs go to the texts of a, else both are
    shuffled; then a's texts meet those of the few sets that are b. Only pairs that the bitmaps allow bring their texts."""
    pairs = _near_pairs(pairs, sets, threshold)
    scratch.append(pairs)
    found, number = _texts(docs, sets, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), scratch)
    texts = save(found, "texts")
    if texts.count() > number:
        texts = save(texts.groupBy("sid").agg(F.first("text").alias("text")), "texts")
        scratch.append(texts)
    small = F.broadcast if pairs.count() <= MOST_BROADCAST else lambda df: df
    right = texts.join(small(pairs.select("b").distinct()), F.col("sid") == F.col("b"), "left_semi").select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    left = texts.join(small(pairs), F.col("sid") == F.col("a")).select("a", F.col("text").alias("text_a"), "b")
    scratch.append(texts)
    return save(left.join(right, "b").select("a", "text_a", "b", "text_b").mapInArrow(_verified(k, threshold), "a long, b long").distinct(), "links")


def oracle(k: int = 5, threshold: int = 80) -> str:
    """DuckDB SQL for jaccard_components() over documents: it counts every shared shingle, so for small tables only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive words as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' ')) end) as s from words),
shingles as materialized (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * n >= {threshold} * (len(p.s) + len(q.s) - n)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as c from sets union select b, c from reach join both_ways on a = doc_id)
select doc_id, len(s)::bigint as n_shingles, component_id from sets join (select doc_id, min(c) as component_id from reach group by doc_id) using (doc_id)
"""
