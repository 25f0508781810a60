"""URL filters: allow and block rules, and trust that spreads over the link graph between hosts.

A url's verdict is its longest fitting rule's, else its host's.  A host's trust is its personalised PageRank from the
hosts of allowed urls along links; its distrust is that from the hosts of blocked urls against links, as a host that
links to blocked ones is not to be trusted.  Every host with allowed, or blocked, urls is a seed and weighs by their
share.  The distrust a seed starts with counts for the host itself only if that is over half, so a few blocked urls
don't block a host, but those that link to it get their part.  A host is blocked if its distrust is over ``threshold`` times its trust.  All of it is DataFrame operations: urls and links
become (host, host, count) rows, summed before they move, and ranks stay distributed; power iterations go on until the
rank that is still to place on all hosts together is under ``REST``, a tenth of what ``judge`` tells apart.

Defined results: a url that is null or has no ``://`` has host and path '' and no rule; a host without links or seeds
has neither trust nor distrust and is allowed; links of a host to itself, to no host, and links in null html count
for nothing; repeated rows are judged alike; a null page_id is carried through; columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import join_skewed, materialize, table

DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 1.0
#: Rank that may be left to place, a tenth of the 1e-9 that distrust has to be over trust for a block.
REST = 1e-10
#: Rounds whose ranks are summed up and written at once.
FOLD = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict of the longest fitting rule (null if none fits)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        found, verdict = F.when(fits, r.name).otherwise(found), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumns({"host": host("url"), "path": path("url")}).withColumns({"rule": found, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): the share of a host's links to other hosts; ``pages`` has host and html."""
    link = F.explode(F.expr(r"""regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["\']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"\'\\s>]*)', 1)"""))
    target = host(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    links = pages.where("html LIKE '%//%'").select(F.col("host").alias("src"), link.alias("link")).select("src", target.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    counted = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(counted.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, own: DataFrame | None = None) -> DataFrame:
    """(host, rank): personalised PageRank of ``seeds`` (host, mass) along ``edges`` (src, dst, weight).

    Rank is the damped sum over rounds of the mass walked so far; mass that stands on a host without links ends there.
    ``rounds``: None goes on until less than ``REST`` is left to place, for a ``damping`` under 1.
    ``own``: the seeds that what they start with counts for, all by default.
    """
    walked, ranks = seeds.select("host", "mass"), [(seeds if own is None else own).select("host", (F.col("mass") * (1 - damping)).alias("rank"))]
    total = lambda: reduce(DataFrame.unionByName, ranks).groupBy("host").agg(F.sum("rank").alias("rank"))
    for _ in count() if rounds is None else range(rounds):
        step = edges.join(walked, edges["src"] == walked["host"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("mass") * F.col("weight")) * damping).alias("mass"))
        walked = materialize(step, "ranks")
        left = walked.agg(F.sum("mass")).first()[0]
        if left is None:
            break
        ranks.append(walked.select("host", (F.col("mass") * (1 - damping)).alias("rank")))
        if rounds is None and left * damping < REST:
            break
        if len(ranks) > FOLD:
            ranks = [materialize(total(), "ranks")]
    return total()


def host_trust(pages: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) of all hosts with either; ``pages`` has host, html and rule_verdict."""
    counts = pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block"))
    counts = materialize(counts, "seeds")
    edges = materialize(host_edges(pages), "edges")
    back = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    reversed_ = edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))
    seeds = lambda verdict, which: counts.where(which).select("host", (F.col(verdict) / F.col("n")).alias("mass"))
    trust = propagate(edges, seeds("allow", "allow > 0"), damping, rounds).select("host", F.col("rank").alias("trust"))
    distrust = propagate(reversed_, seeds("block", "block > 0"), damping, rounds, seeds("block", "2 * block > n")).select("host", F.col("rank").alias("distrust"))
    both = trust.join(distrust, "host", "full")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict."""
    ruled = with_rule(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), rules)
    blocked = host_trust(ruled, damping, rounds).where(F.col("distrust") > threshold * F.col("trust") + 1e-9).select("host", F.lit("block").alias("host_verdict"))
    judged = join_skewed(ruled.select("page_id", "host", "path", "rule", "rule_verdict"), materialize(blocked, "blocked"), "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _op9_sql(damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same judgement as SQL, its rounds written out."""
    fits = "\n".join(
        f"         WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'" for i, r in enumerate(sorted(RULES, key=lambda r: (-len(r.name), r.name)))
    )
    longest = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    name, verdict = fits.format(*(r.name for r in longest)), fits.format(*(r.verdict for r in longest))
    walks, ranks = [], {}
    for kind, edges, seed in (("trust", "edges", "allow"), ("distrust", "back", "block")):
        walks.append(f"{kind}0 AS (SELECT host, {seed} / n AS mass FROM counts WHERE 2 * {seed} > n)")
        walks += [f"{kind}{i} AS (SELECT dst AS host, sum(mass * weight) * {damping} AS mass FROM {edges} JOIN {kind}{i - 1} ON src = host GROUP BY dst)" for i in range(1, rounds + 1)]
        ranks[kind] = " UNION ALL ".join(f"SELECT host, mass * {1 - damping} AS rank FROM {kind}{i}" for i in range(rounds + 1))
    after = r"regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)"
    return f"""
WITH cut AS (
  SELECT page_id, html, translate(coalesce({after.format("url")}, ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (
  SELECT page_id, html, host, path,
    CASE
{name} END AS rule,
    CASE
{verdict} END AS rule_verdict
  FROM cut
), counts AS (
  SELECT host, count(*) AS n, count(*) FILTER (rule_verdict = 'allow') AS allow, count(*) FILTER (rule_verdict = 'block') AS block FROM ruled WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]*)', 1)) AS link FROM ruled
), hosts AS (
  SELECT src, translate({after.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")}, '{_UPPER}', '{_LOWER}') AS dst FROM links
), counted AS (
  SELECT src, dst, count(*) AS n FROM hosts WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), edges AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM counted
), back AS (
  SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM edges
), {", ".join(walks)}, blocked AS (
  SELECT host FROM counts LEFT JOIN (SELECT host, sum(rank) AS trust FROM ({ranks["trust"]}) GROUP BY host) USING (host)
    LEFT JOIN (SELECT host, sum(rank) AS distrust FROM ({ranks["distrust"]}) GROUP BY host) USING (host)
  WHERE coalesce(distrust, 0) > {threshold} * coalesce(trust, 0) + 1e-9
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


OP9_SQL = _op9_sql()
