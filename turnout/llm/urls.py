"""Url verdicts by rules and, where none fits, by trust and distrust over links between hosts.

Rules seed the hosts: the share of a host's pages that rules allow less the share that they block
is its trust seed, or if negative its distrust seed.  Trust then follows links (personalised
PageRank), distrust goes against them.  Scores are on the scale of seeds: a host that rules
block entirely and that nothing else reaches has distrust 1, however many hosts there are.  A
host whose distrust exceeds its trust by ``THRESHOLD`` is blocked; a host this close to the threshold that
less than 1e-4 decides may go either way.

Null urls and urls without ``://`` have an empty host and path, take no part in the graph and are
allowed.  A null html has no links; long ones are searched whole and in linear time.  Ties cannot arise.  Repeated rows are judged alike; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnout.llm.base import ascii_lower, saved

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
#: Walks go on until no host gains more than TOLERANCE in a round, or for ROUNDS rounds.
TOLERANCE = 1e-5
ROUNDS = 200
#: Rounds of the SQL version, which cannot stop early; what is left after them is below 1e-6 of a seed.
SQL_ROUNDS = 100
THRESHOLD = 0.5
#: Rounds that one job computes before its scores are written.
ROUNDS_A_JOB = 5
#: A match ends at the next tag and no blank can be taken twice, so it is found in linear time.
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*(?:["']\s*)?(?:https?:)?//([^/?#"'\s<>]+)"""


def address(url: str) -> tuple[Column, Column]:
    """Host and path of the url column."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def fitting(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, host, path and what the rules say."""
    host, path = address("url")
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    return placed.select("*", rule.alias("rule"), verdict.alias("_said"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and the number of pages that link them, between different hosts."""
    host, _ = address("url")
    linked = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.filter(F.col("html").contains("//")).select(host.alias("src"), F.explode(linked).alias("_to"))
    return (links.select("src", ascii_lower(F.col("_to")).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages")))


def host_seeds(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """One row per host that has pages or links, with its share allowed less that blocked."""
    side = F.when(F.col("_said") == "allow", 1.0).when(F.col("_said") == "block", -1.0).otherwise(0.0)
    own = judged(pages, rules).filter("host <> ''").groupBy("host").agg(F.avg(side).alias("seed"))
    _, said = fitting(rules, F.col("host"), F.lit("/"))
    met = (edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().join(own, "host", "left_anti")
           .withColumn("_said", said).select("host", side.alias("seed")))
    return own.unionByName(met)


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host``, ``trust`` and ``distrust``; ``seeds`` has one row per host with ``seed`` in -1 to 1.

    Both walks run as one: a way goes from a host to another and is of one kind.
    """
    ways = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "pages")
            .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "pages")))
    out = ways.groupBy("kind", "host").agg(F.sum("pages").alias("_all"))
    ways = saved(ways.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("pages") / F.col("_all")).alias("share")), "ways")
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.greatest("seed", F.lit(0.0)).alias("seed")),
                              F.struct(F.lit("distrust").alias("kind"), F.greatest(-F.col("seed"), F.lit(0.0)).alias("seed"))))
    seeds = saved(seeds.select("host", kinds.alias("_k")).select("host", "_k.kind", "_k.seed"), "seeds")
    if ways.isEmpty():
        rounds = 0
    # what a host has so far, and what of it came in the last round and goes on
    scores = seeds.select("host", "kind", F.col("seed").alias("score"), F.col("seed").alias("gain"))
    for n in range(rounds):
        given = (scores.filter("gain > 0").join(ways, ["kind", "host"])
                 .groupBy("kind", "to").agg((damping * F.sum(F.col("gain") * F.col("share"))).alias("_in"))
                 .withColumnRenamed("to", "host"))
        gain = F.coalesce("_in", F.lit(0.0))
        scores = scores.join(given, ["kind", "host"], "left").select("host", "kind", (F.col("score") + gain).alias("score"), gain.alias("gain"))
        if n % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            scores = saved(scores, "scores")
            if scores.agg(F.max("gain")).first()[0] <= TOLERANCE:
                break
    return scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
                                      F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))


def url_verdicts(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Per page its host, path, rule and verdict."""
    edges = saved(host_edges(pages), "edges")
    seeds = host_seeds(pages, edges, rules)
    scores = spread(edges, seeds, damping, rounds)
    blocked = saved(scores.filter(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit("block").alias("_host_said")), "blocked")
    return judged(pages, rules).join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_said", "_host_said", F.lit("allow")).alias("verdict"))


def oracle(rules=RULES, damping: float = DAMPING, rounds: int = SQL_ROUNDS, threshold: float = THRESHOLD) -> str:
    cases = {"rule": [], "_said": []}
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN "
        cases["rule"].append(fits + f"'{text}'")
        cases["_said"].append(fits + f"'{said}'")
    case = {k: "CASE " + " ".join(v) + " END" for k, v in cases.items()}
    link = LINK.replace("'", "''")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = reduce(lambda sql, n: sql + f""", r{n + 1} AS MATERIALIZED (
        SELECT s.host, s.kind, s.seed + {damping} * coalesce(g.v, 0) AS score FROM seeds s LEFT JOIN (
            SELECT w.kind, w.to_host, sum(r.score * w.share) AS v FROM r{n} r JOIN ways w ON r.kind = w.kind AND r.host = w.host
            GROUP BY ALL) g ON g.kind = s.kind AND g.to_host = s.host)""", range(rounds), "")
    return f"""
    WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    named AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM cut),
    placed AS (SELECT page_id, html, {lower.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM named),
    judged AS (SELECT *, {case["rule"]} AS rule, {case["_said"]} AS _said FROM placed),
    links AS (SELECT DISTINCT page_id, host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS t FROM placed),
    edges AS (SELECT src, {lower.format("t")} AS dst, count(*) AS pages FROM links
        WHERE src <> '' AND t <> '' AND src <> {lower.format("t")} GROUP BY ALL),
    own AS (SELECT host, avg(CASE _said WHEN 'allow' THEN 1.0::DOUBLE WHEN 'block' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) AS seed FROM judged WHERE host <> '' GROUP BY host),
    met AS (SELECT host, '/' AS path FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges) WHERE host NOT IN (SELECT host FROM own)),
    nodes AS (SELECT host, seed FROM own UNION ALL SELECT host, CASE {case["_said"]} WHEN 'allow' THEN 1.0 WHEN 'block' THEN -1.0 ELSE 0.0 END FROM met),
    seeds AS MATERIALIZED (SELECT host, 'trust' AS kind, greatest(seed, 0) AS seed FROM nodes UNION ALL SELECT host, 'distrust', greatest(-seed, 0) FROM nodes),
    ways AS MATERIALIZED (SELECT kind, host, to_host, pages / sum(pages) OVER (PARTITION BY kind, host) AS share FROM (
        SELECT 'trust' AS kind, src AS host, dst AS to_host, pages FROM edges UNION ALL SELECT 'distrust', dst, src, pages FROM edges)),
    r0 AS (SELECT host, kind, seed AS score FROM seeds){step},
    blocked AS (SELECT host FROM r{rounds} GROUP BY host
        HAVING sum(CASE kind WHEN 'distrust' THEN score ELSE -score END) >= {threshold})
    SELECT page_id, host, path, rule, coalesce(_said, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged"""
