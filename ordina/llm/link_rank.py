"""URL filter by rules and by propagation over the link graph, in DataFrame functions alone.

Rules judge pages by host and path. Pages that rules allow make their hosts trusted seeds,
pages that rules block make them blocked seeds, both in page units. Trust spreads along
links (personalised PageRank, not scaled down: the seeds plus what the damped links bring),
distrust against them, over edges between different hosts. A host is blocked when its
distrust less its trust exceeds a share of its pages; its pages without a rule follow it.

Edges are links of the pages to other hosts, counted by host pair: values of the attributes href
and src, in quotes of either kind or none, blanks around them dropped. A link's host is named as a
page's is (in lower case, with its port); user names before an @ are dropped. Relative
links stay on the page's own host and carry nothing. Rounds go on until what is left to come is
negligible. Counting is by partial sums, a hub's links are split over several tasks, and the
verdicts return by a checked broadcast or a salted join, so a host with a third of all pages or
links is no hot spot.

Defined cases: a null url or one without `://` has empty host and path, no rule fits, and it is
allowed (the empty host takes no part in the graph). Null html has no links; html is read whole,
however long. Repeated rows are pages of their own. Of rules of equal length, that with the longer
host wins, then the first. An empty table gives an empty result. Columns other than id, url and html are
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.llm._store import durable, flag, forget, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
BLANK = "\\x09\\x0A\\x0C\\x0D\\x20"
LINK = f"(?i)[{BLANK}\"'](?:href|src)[{BLANK}]*=[{BLANK}]*[\"']?[{BLANK}]*([^{BLANK}\"'>]*)"
ABSOLUTE = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]*)"
#: Links of a host that one task handles in a round.
HUB = 100_000


@dataclass(frozen=True)
class Rule:
    """host: it and its subdomains; path: what the url's path starts with after the slash."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (Rule("com", "en/", "block"), Rule("example.com", "en/7", "allow"), Rule("net", "de/", "allow"), Rule("example.net", "de/8", "block"), Rule("org", "es/", "block"))


@dataclass(frozen=True)
class Spread:
    """damping of the propagation; threshold: the share of a host's pages that distrust less trust must exceed; cut: rounds between written tables.

    tolerance: rounds go on until all that is still to come, over all hosts together, is no more than this part of the threshold of one page.
    """

    damping: float = 0.85
    threshold: float = 0.5
    cut: int = 4
    tolerance: float = 1e-6


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ruled(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows (with url) with host, path, rule and ruled_verdict; the longest rule that fits wins (of equals, the one with the longer host)."""
    url = F.coalesce("url", F.lit(""))
    out = rows.withColumns({"host": _lower(F.regexp_extract(url, HOST, 1)), "path": F.regexp_extract(url, PATH, 1)})
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host))):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(f"/{r.path}"))
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    empty = F.lit(None).cast("string")
    return out.withColumns({"rule": empty if name is None else name, "ruled_verdict": empty if verdict is None else verdict})


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between hosts, from pages with host and html."""
    link = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.where("host != ''").select("host", link.alias("link"))
    links = links.select(F.col("host").alias("src"), _lower(F.regexp_extract("link", ABSOLUTE, 1)).alias("dst"))
    return links.where("dst != '' and dst != src").groupBy("src", "dst").agg(F.count("*").alias("links"))


def host_scores(pages: DataFrame, how: Spread = Spread()) -> DataFrame:
    """host, pages, trust, distrust, host_blocked, from pages with host, html and ruled_verdict."""
    spark = pages.sparkSession
    held = durable(edges(pages), "links-edges")
    hosts = pages.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), *[F.count_if(F.col("ruled_verdict") == v).cast("double").alias(v) for v in ("allow", "block")])
    outside = held.join(hosts, held["dst"] == hosts["host"], "left_anti").select(F.col("dst").alias("host")).distinct()
    hosts = durable(hosts.unionByName(outside.select("host", F.lit(0).cast("long").alias("pages"), F.lit(0.0).alias("allow"), F.lit(0.0).alias("block"))), "links-hosts")
    both = held.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "links").union(held.select(F.lit(1), "dst", "src", "links"))
    total = both.groupBy(F.col("kind").alias("k"), F.col("a").alias("h")).agg(F.sum("links").alias("total"), F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    total = durable(total, "links-totals")
    step = both.join(total, (F.col("kind") == F.col("k")) & (F.col("a") == F.col("h")))
    step = step.select("kind", "a", "b", (F.col("links") / F.col("total")).alias("share"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("int").alias("parts"))
    seed = hosts.select(F.lit(0).alias("kind"), "host", F.col("allow").alias("seed")).union(hosts.select(F.lit(1), "host", "block"))
    seed = seed.join(total, (F.col("kind") == F.col("k")) & (F.col("host") == F.col("h")), "left").select("kind", "host", "seed", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = seed.select("kind", F.col("host").alias("a"), F.col("host").alias("b"), F.lit(None).cast("double").alias("share"), F.lit(0).alias("part"), "parts")
    step = durable(step.unionByName(own), "links-steps")  # a step of a host to itself, without share, keeps what it has
    # what a round brings shrinks by damping at least, so all later ones together bring no more than damping / (1 - damping) times that
    if not 0 <= how.damping < 1:
        raise ValueError("damping is 0 or more and below 1")
    least, more = how.tolerance * how.threshold, how.damping / (1 - how.damping)
    mass = old = durable(seed.select("kind", "host", F.col("seed").alias("mass"), F.col("seed").alias("new"), "parts"), "links-mass")
    while (mass.agg(F.sum("new")).first()[0] or 0.0) * more > least:
        for _ in range(how.cut):
            dealt = mass.select(F.col("kind").alias("k"), F.col("host").alias("h"), "mass", "new", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
            on = dealt.join(step, (F.col("k") == F.col("kind")) & (F.col("h") == F.col("a")) & (F.col("p") == F.col("part")))
            come = F.coalesce(how.damping * F.col("new") * F.col("share"), F.lit(0.0))
            on = on.select("kind", F.col("b").alias("host"), F.when(F.col("share").isNull(), F.col("mass")).otherwise(come).alias("mass"), come.alias("new"), "parts")
            mass = on.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("new").alias("new"), F.max("parts").alias("parts"))
        mass = durable(mass, "links-mass")
        forget(spark, old)
        old = mass
    both = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("mass"))).alias("distrust"))
    out = both.join(hosts.select(F.col("host").alias("h"), "pages"), F.col("host") == F.col("h")).drop("h")
    out = durable(out, "links-scores")
    forget(spark, held, hosts, total, step, mass)
    return out.withColumn("host_blocked", F.col("distrust") - F.col("trust") > how.threshold * F.col("pages"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, how: Spread = Spread(), id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_blocked."""
    rows = ruled(pick(pages, page_id=id, url=url, html=html), rules)
    blocked = host_scores(rows, how).where("host_blocked").select("host")
    out = flag(rows.select("page_id", "host", "path", "rule", "ruled_verdict"), F.col("host"), blocked, "host_blocked")
    verdict = F.coalesce("ruled_verdict", F.when(F.col("host_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_blocked")


def judge_sql(table: str = "pages", rules: tuple[Rule, ...] = RULES, how: Spread = Spread()) -> str:
    """judge() in DuckDB SQL; what is left to come after 300 rounds is below any rounding."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def case(pick) -> str:
        lines = [f"WHEN (host = {quoted(r.host)} OR host LIKE {quoted('%.' + r.host)}) AND starts_with(path, {quoted('/' + r.path)}) THEN {quoted(pick(r))}" for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))]
        return "CASE " + " ".join(lines) + " END"

    return f"""
WITH RECURSIVE parts AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM {table}),
ruled AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled_verdict FROM parts),
links AS (SELECT host, unnest(regexp_extract_all(html, {quoted(LINK)}, 1)) AS link FROM ruled WHERE host <> ''),
held AS (SELECT host AS src, t AS dst, count(*) AS links
 FROM (SELECT host, translate(regexp_extract(link, '{ABSOLUTE}', 1), '{UPPER}', '{LOWER}') AS t FROM links) WHERE t <> '' AND t <> host GROUP BY ALL),
own AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled_verdict = 'allow')::DOUBLE AS allowed, count(*) FILTER (ruled_verdict = 'block')::DOUBLE AS blocked FROM ruled WHERE host <> '' GROUP BY host),
hosts AS (SELECT * FROM own UNION ALL SELECT DISTINCT dst, 0, 0.0, 0.0 FROM held WHERE dst NOT IN (SELECT host FROM own)),
way AS (SELECT 0 AS kind, src AS a, dst AS b, links FROM held UNION ALL SELECT 1, dst, src, links FROM held),
step AS (SELECT kind, a, b, links / sum(links) OVER (PARTITION BY kind, a) AS share FROM way),
seeds AS (SELECT 0 AS kind, host, allowed AS seed FROM hosts UNION ALL SELECT 1, host, blocked FROM hosts),
flow AS (SELECT 0 AS k, kind, host, seed::DOUBLE AS new FROM seeds UNION ALL
 SELECT k + 1, kind, b, new FROM (SELECT f.k, s.kind, s.b, sum({how.damping} * f.new * s.share) AS new FROM flow f JOIN step s ON f.kind = s.kind AND f.host = s.a WHERE f.k < 300 GROUP BY ALL) WHERE new > 1e-15),
bad AS (SELECT host FROM (SELECT host, coalesce(sum(mass) FILTER (kind = 1), 0) - coalesce(sum(mass) FILTER (kind = 0), 0) AS d FROM (SELECT kind, host, sum(new) AS mass FROM flow GROUP BY ALL) GROUP BY host) JOIN hosts USING (host) WHERE d > {how.threshold} * pages)
SELECT page_id, host, path, rule, coalesce(ruled_verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict, host IN (SELECT host FROM bad) AS host_blocked FROM ruled
"""
