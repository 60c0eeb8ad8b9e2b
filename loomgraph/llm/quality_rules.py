"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules read counts off every whole text. A score then adds up, over a few signals made of those counts, how much more
often documents labelled bad (quality 0) than good ones fall into the signal's interval, in hundredths of a natural
logarithm. It is fitted on the labelled documents that a hash of the id picks (FIT, 3 in 16); the fit is a table of
at most one row for each signal and interval. The other labelled documents are the holdout that chooses a cutoff for
each stratum: going from the loosest to the strictest value of a fixed grid, a cutoff is accepted while the exact
binomial test at the corrected level shows that it rejects less than a share `risk` of the good documents (quality 1,
not toxic, base rules passed) of the stratum. The walk stops at the first failure (fixed-sequence testing, which needs
no correction within a grid); over strata the level is divided by their number (Bonferroni). So with probability
1 - level every stratum loses at most a share `risk` of its good documents. A stratum with too few labels gets no cutoff
(with four strata and none rejected it takes 144 good ones), and nothing more than the base rules applies to it. Of the
accepted cutoffs the strictest that rejects a holdout document labelled bad which the next looser one keeps is used, so
a cutoff that does nothing but reject good documents is never chosen.

Defined cases: a null or wordless text has zero counts and fails the base rules. A null stratum is a stratum. Labels that
contradict one another or are null count as neither good nor bad; labels without a document are ignored. Repeated rows are judged
each; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import save

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: name, signal over the counts, and the edges of its intervals.
SIGNALS: list[tuple[str, str, list[int]]] = [
    ("words", "n_words", [30, 45, 70, 100, 150, 250, 400, 700, 1500, 4000]),
    ("symbols", "floor(1000 * n_symbols / nullif(n_words, 0))", [1, 5, 10, 20, 40, 80, 150, 300]),
    ("dup_lines", "floor(1000 * n_dup_lines / nullif(n_lines, 0))", [1, 50, 100, 200, 300, 500, 700]),
    ("repeats", "floor(1000 * n_repeat_words / nullif(n_words, 0))", [1, 30, 60, 100, 150, 200, 250]),
    ("word_chars", "floor(100 * word_chars / nullif(n_words, 0))", [250, 350, 400, 450, 500, 550, 600, 700, 900, 1500]),
    ("line_words", "floor(n_words / nullif(n_lines, 0))", [2, 4, 6, 8, 12, 20, 40, 100]),
]
FIT = "012"  # first digits of the md5 of the ids whose labels the score is fitted on, three in sixteen; the others are held out
CUTOFFS = [1000, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100, 50, 0]
RISK, LEVEL = 0.03, 0.05


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words which occurs twice or more."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(hashes: Column) -> Column:
        paired = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda a: F.filter(a, lambda s, j: (s["x"] == F.get(a, j - 1)["x"]) | (s["x"] == F.get(a, j + 1)["x"]))
        starts = F.sort_array(F.transform(_let(paired, again), lambda s: s["i"]))
        total = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda n, j: n + F.least(F.lit(width), F.get(p, j + 1) - F.get(p, j)))
        return _let(starts, total)

    some = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > width, some).otherwise(F.lit(0).cast("long"))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds words (array), n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda c: F.length(F.translate(c, SPACES, ""))
    words = docs.withColumn("words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).withColumn("lines", F.filter(F.split(text, "\n"), lambda line: bare(line) > 0))
    return words.select(
        *docs.columns, "words", F.size("words").cast("long").alias("n_words"), bare(text).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ B(n, p), summed in logarithms; 1 where k is above n * p, as no test would pass there."""
    odds = log(p) - log(1 - p)
    first = n * log(1 - p)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["total"], term) - top))).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(F.exp(summed))


def _intervals() -> Column:
    """For each signal, the number of edges that it has passed."""
    return F.array(*[sum((F.coalesce(F.expr(signal) >= edge, F.lit(False)).cast("int") for edge in edges), F.lit(0)) for _, signal, edges in SIGNALS])


def fit_score(labelled: DataFrame) -> DataFrame:
    """Rows (at, interval, weight): for the at-th signal, from rows (intervals, good) of labelled documents."""
    counted = labelled.select("good", F.posexplode("intervals").alias("at", "interval")).groupBy("at", "interval").agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    totals = counted.groupBy("at").agg(F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
    return counted.join(totals, "at").select("at", "interval", F.expr("cast(round(100 * ln((b + 1) * (all_g + 10) / ((g + 1) * (all_b + 10)))) as long)").alias("weight"))


def score_of(weights: dict[tuple[int, int], int]) -> Column:
    """The sum of the weights of a document's intervals; an interval without labelled documents weighs nothing."""
    tables = [F.array(*[F.lit(weights.get((at, i), 0)).cast("long") for i in range(len(edges) + 1)]) for at, (_, _, edges) in enumerate(SIGNALS)]
    return sum((F.get(table, F.get("intervals", F.lit(at))) for at, table in enumerate(tables)), F.lit(0).cast("long"))


def choose_cutoffs(scored: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Rows (stratum, cutoff) from rows (stratum, score, good) of held out documents."""
    tests = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(cut).cast("long").alias("cutoff"), (F.col("score") > cut).cast("long").alias("hit")) for j, cut in enumerate(CUTOFFS)])
    of = lambda good, what: F.sum(F.when(F.col("good") == good, what).otherwise(0))
    counted = scored.select("stratum", "good", F.explode(tests).alias("t")).groupBy("stratum", "t.j", "t.cutoff").agg(of(True, 1).alias("n"), of(True, F.col("t.hit")).alias("k"), of(False, F.col("t.hit")).alias("caught"))
    counted = save(counted, "tests")
    strata = max(1, counted.select("stratum").distinct().count())
    walk = Window.partitionBy("stratum").orderBy("j")
    passed = counted.withColumn("ok", F.min(binomial_tail(F.col("k"), F.col("n"), risk) <= level / strata).over(walk)).withColumn("more", F.col("caught") > F.coalesce(F.lag("caught").over(walk), F.lit(0)))
    return passed.where("ok and more").groupBy("stratum").agg(F.min("cutoff").alias("cutoff"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, score, cutoff), then the columns `keys` of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"), *keys)
    features = save(with_counts(plain).select("doc_id", "stratum", *COUNTS, "n_lines", *keys), "features")
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id")
    named = named.agg(F.min("quality").alias("least"), F.max("quality").alias("most"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"), F.count(F.when(F.col("quality").isNull(), 1)).alias("nulls"))
    good = F.expr("case when least = 1 and toxic = 0 and nulls = 0 then true when most = 0 and nulls = 0 then false end")
    known = named.select("doc_id", good.alias("good"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*FIT).alias("fits")).where("good is not null")
    measured = features.where(f"not ({BASE_FAILED})").select("doc_id", "stratum", _intervals().alias("intervals")).join(known, "doc_id")
    measured = save(measured, "labelled")
    weights = {(r["at"], r["interval"]): r["weight"] for r in fit_score(measured.where("fits")).collect()}  # a row for each signal and interval
    score = score_of(weights)
    cutoffs = choose_cutoffs(measured.where("not fits").select("stratum", score.alias("score"), "good"), risk, level)
    judged = features.withColumn("intervals", _intervals()).withColumn("score", score)
    joined = judged.alias("f").join(cutoffs.alias("c"), F.expr("f.stratum <=> c.stratum"), "left").select("f.*", "c.cutoff")
    verdict = joined.withColumn("base_failed", F.expr(BASE_FAILED))
    return verdict.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("score") <= F.col("cutoff"), F.lit(True))).alias("kept"), "stratum", "score", "cutoff", *keys)


def oracle() -> str:
    """DuckDB SQL for judge() over documents and labels."""
    counts = ", ".join(" + ".join(f"coalesce(({signal} >= {edge})::int, 0)" for edge in edges) for _, signal, edges in SIGNALS)
    at = list(range(len(SIGNALS)))
    return rf"""
with docs as (select doc_id, lang as stratum, coalesce(text, '') as text, row_number() over () as r from documents),
words as (select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from docs),
windows as (select r, unnest(v) as v, generate_subscripts(v, 1) as i from (select r, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: hash(list_slice(w, i, i + {WINDOW - 1}))) as v from words)),
repeated as (select r, i from (select r, i, count(*) over (partition by r, v) as c from windows) where c > 1),
covered as (select r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nxt from repeated) group by r),
lines as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as l from docs) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
features as materialized (
  select r, doc_id, stratum, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from docs join words using (r) left join covered using (r) left join lines using (r)),
known as (select doc_id, case when min(quality) = 1 and max(coalesce(toxic, 1)) = 0 and count(*) = count(quality) then true when max(quality) = 0 and count(*) = count(quality) then false end as good,
    md5(doc_id::varchar)[1] in {tuple(FIT)} as fits from labels group by doc_id),
intervals as materialized (select r, doc_id, stratum, {BASE_FAILED} as base_failed, unnest({at}) as sig, unnest([{counts}]) as passed from features),
fitted as (select sig, passed, count(*) filter (where good) as g, count(*) filter (where not good) as b from intervals join known using (doc_id) where fits and not base_failed and good is not null group by all),
weights as (select sig, passed, round(100 * ln((b + 1) * (sum(g) over w + 10) / ((g + 1) * (sum(b) over w + 10))))::bigint as weight from fitted window w as (partition by sig)),
scores as materialized (select r, sum(coalesce(weight, 0))::bigint as score from intervals left join weights using (sig, passed) group by r),
held as (select stratum, score, good from features join scores using (r) join known using (doc_id) where not fits and good is not null and not ({BASE_FAILED})),
tests as (select stratum, j, cutoff, count(*) filter (where good) as n, count(*) filter (where good and score > cutoff) as k, count(*) filter (where not good and score > cutoff) as caught from held, (select unnest({CUTOFFS}) as cutoff, unnest(range(0, {len(CUTOFFS)})) as j) group by all),
judged as (
  select *, case when k > n * {RISK} then 1.0 else list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n + 1) - (case when i = 0 then 0 else lgamma(i + 1) end) - (case when n = i then 0 else lgamma(n - i + 1) end) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) end
    <= {LEVEL} / (select greatest(1, count(distinct coalesce(stratum, '\0'))) from tests) as ok, caught > coalesce(lag(caught) over (partition by stratum order by j), 0) as more from tests),
cutoffs as materialized (select stratum, min(cutoff)::bigint as cutoff from (select *, min(ok::int) over (partition by stratum order by j) as walk from judged) where walk = 1 and more group by all)
select doc_id, {", ".join(COUNTS)}, {BASE_FAILED} as base_failed, not ({BASE_FAILED}) and coalesce(score <= cutoff, true) as kept, f.stratum, score, cutoff
from features f join scores using (r) left join cutoffs c on c.stratum is not distinct from f.stratum
"""
