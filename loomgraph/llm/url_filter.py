"""URL filters: host and path rules, and link-graph propagation for urls that no rule fits. DataFrame functions only.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's; the longest fitting rule decides. For other urls the host decides: trust is personalised PageRank from the hosts
of allowed urls over host edges, distrust the same from the hosts of blocked urls over reversed edges; a host whose
distrust is above its trust by more than `threshold` times their sum is blocked. Seeds weigh a host by its number of
allowed (blocked) urls, so a host's scores and verdict depend on what links to it and on nothing else in the table.
Host edges come from the absolute and protocol-relative links in the pages' html, one for each pair of hosts.

Every round joins scores to edges and sums by host, so what is shuffled is bounded by the edges; rounds stop when no score
moves by more than `tolerance` times (1 - damping) / damping of itself. Hosts first reached in a round have moved by their
whole score, so rounds go on until no new host is reached. A number of `rounds` can be given instead.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Repeated rows
are judged each. Null html has no links. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import forget, save

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 20, 1e-9, 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits, or null; rules of one length decide in the order given."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of hosts from columns host and html; links within a host are left out."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    return links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (host, trust, distrust) from seeds (host, trust, distrust) and edges; scores are in the unit of the seeds."""
    forward = edges.join(edges.groupBy("src").agg(F.count("*").alias("n")), "src").select(F.lit("trust").alias("kind"), "src", "dst", (1 / F.col("n")).alias("w"))
    backward = edges.join(edges.groupBy("dst").agg(F.count("*").alias("n")), "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.col("n")).alias("w"))
    flows = save(forward.union(backward), "flows")
    start = save(seeds.select("host", F.lit("trust").alias("kind"), F.col("trust").alias("seed")).union(seeds.select("host", F.lit("distrust"), "distrust")).where("seed > 0"), "seeds")
    held = save(start.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score")), "scores")
    for _ in count() if rounds is None else range(rounds):
        given = held.join(flows, (held["host"] == flows["src"]) & (held["kind"] == flows["kind"])).select(F.col("dst").alias("host"), flows["kind"], (held["score"] * F.col("w") * damping).alias("score"))
        restart = start.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score"))
        after = save(given.union(restart).groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
        moved = after.alias("a").join(held.alias("b"), ["host", "kind"], "left").agg(F.max(F.abs(F.col("a.score") - F.coalesce("b.score", F.lit(0.0))) / F.col("a.score"))).first()[0]
        forget(held)
        held = after
        if moved is None or moved * damping <= tolerance * (1 - damping):
            break
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return held.groupBy("host").agg(pick("trust"), pick("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict)."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = save(named.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r")), "judged")
    edges = save(host_edges(named), "edges")
    by_host = judged.where("r is not null").groupBy("host").agg(F.count(F.when(F.col("r.verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("r.verdict") == "block", 1)).alias("blocked"))
    by_host = save(by_host, "hosts")
    scores = propagate(by_host.select("host", F.col("allowed").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust")), edges, damping, rounds)
    bad = scores.where(F.col("distrust") - F.col("trust") > threshold * (F.col("distrust") + F.col("trust"))).select("host", F.lit(True).alias("bad"))
    out = judged.join(bad, "host", "left")
    return out.select("page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for filter_urls() over pages whose links stay within their hosts, such as the sample's.

    Elsewhere it differs: it has shares of the seeds, a fixed number of rounds and a threshold on the shares.
    """
    lower = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    pick = lambda what: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{what(h, p, v)}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " end"
    link = LINK.replace("'", "''")
    steps = []
    for i in range(rounds):
        steps.append(f"s{i + 1} as materialized (select host, kind, sum(score) as score from (select dst as host, f.kind, score * w * {DAMPING} as score from s{i} s join flows f on s.host = f.src and s.kind = f.kind union all select host, kind, score from s0) group by all)")
    return rf"""
with parsed as materialized (select page_id, {lower % r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, html from pages),
judged as materialized (select page_id, host, path, {pick(lambda h, p, v: h + p)} as rule, {pick(lambda h, p, v: v)} as said from parsed),
edges as materialized (select distinct src, {lower % "d"} as dst from (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) as d from parsed) where src <> '' and d <> '' and src <> {lower % "d"}),
flows as materialized (select 'trust' as kind, src, dst, 1.0::double / count(*) over (partition by src) as w from edges union all select 'distrust', dst, src, 1.0::double / count(*) over (partition by dst) from edges),
seeds as (select host, 'trust' as kind, count(*) filter (where said = 'allow') / greatest(1, (select count(*) from judged where said = 'allow'))::double as seed from judged where rule is not null group by host
  union all select host, 'distrust', count(*) filter (where said = 'block') / greatest(1, (select count(*) from judged where said = 'block'))::double from judged where rule is not null group by host),
s0 as materialized (select host, kind, seed * {1 - DAMPING!r} as score from seeds where seed > 0),
{", ".join(steps)},
bad as (select host from s{rounds} group by host having coalesce(sum(score) filter (where kind = 'distrust'), 0) - coalesce(sum(score) filter (where kind = 'trust'), 0) > {THRESHOLD!r})
select page_id, host, path, rule, coalesce(said, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from judged
"""
