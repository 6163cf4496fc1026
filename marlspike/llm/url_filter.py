"""URL filters: host and path rules, and verdicts for other hosts from the graph of links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import checkpoint, col, forget

#: Rule and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Part of a host's rank that its links pass on, rounds between two looks at the ranks, and the part of all
#: weight by which ranks may still change between two looks when rounds end.
DAMPING, STEP, TOLERANCE = 0.85, 5, 1e-6
#: A host is blocked if distrust is at least this part of trust and distrust together.
BLOCK_PART = 0.75
#: Links in a page, absolute or relative to its scheme.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a domain above it and the start of the path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts; those of a host are counted before they are shuffled."""
    links = F.regexp_extract_all(col(html_col), F.lit(LINK), 1)
    pairs = pages.select(host_of(col(url_col)).alias("src"), F.explode(links).alias("link"))
    pairs = pairs.select("src", host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return pairs.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank over edges (src, dst, n) from seeds (host, weight).

    rank = (1 - damping) * weight + damping * what linking hosts pass on, in proportion to n; hosts
    without links pass nothing on. Contributions are summed before the shuffle; every STEP rounds
    are checkpointed and compared with those before. Rounds go on until no host is reached that was
    not before and ranks change by at most `tolerance` of all weight."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = checkpoint(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("part")))
    start = checkpoint(seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank")))
    weight = start.agg(F.sum("rank")).first()[0]
    if not weight or flow.limit(1).count() == 0:
        return start
    rank = start
    while True:
        before = rank
        for _ in range(STEP):
            passed = rank.join(flow, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("part")).alias("rank"))
            rank = start.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank"))
        rank = checkpoint(rank)
        both = rank.select("host", "rank", F.lit(0).alias("old")).unionByName(before.select("host", -F.col("rank"), F.lit(1)).toDF("host", "rank", "old"))
        moved = both.groupBy("host").agg(F.abs(F.sum("rank")).alias("d"), F.max("old").alias("old")).agg(F.sum("d").alias("d"), F.min("old").alias("old")).first()
        if before is not start:
            forget(before)
        if moved["old"] == 1 and moved["d"] <= tolerance * weight:
            forget(flow, start)
            return rank


def judge_hosts(pages: DataFrame, edges: DataFrame, damping: float = DAMPING, block_part: float = BLOCK_PART) -> DataFrame:
    """(of, trust, distrust, blocked) for the hosts that trust or distrust reaches.

    pages has host and ruled, the verdict of a rule or null. A host's seed weights are its numbers of
    allowed and of blocked pages. Trust follows links; distrust runs against them, from a host to
    those that link to it."""
    seeds = checkpoint(pages.where("ruled IS NOT NULL AND host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("a"), F.count_if(F.col("ruled") == "block").cast("double").alias("b")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(edges, seeds.where("a > 0").select("host", F.col("a").alias("weight")), damping)
    distrust = propagate(back, seeds.where("b > 0").select("host", F.col("b").alias("weight")), damping)
    both = trust.select("host", F.col("rank").alias("t"), F.lit(0.0).alias("d")).unionByName(distrust.select("host", F.lit(0.0).alias("t"), F.col("rank").alias("d")))
    scores = both.groupBy(F.col("host").alias("of")).agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
    return scores.withColumn("blocked", (F.col("distrust") > 0) & (F.col("distrust") >= block_part * (F.col("trust") + F.col("distrust"))))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and by ('rule' or 'graph') of every row of pages.

    The rule decides if one fits; else the host's trust and distrust do, and hosts that neither
    reaches are allowed. A null URL has no host and is allowed; null HTML has no links; ids may be
    null or repeated; no rows give no rows; other columns are ignored."""
    host, path = host_of(col(url_col)), path_of(col(url_col))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    judged = checkpoint(judged)
    edges = checkpoint(host_edges(pages, url_col, html_col))
    hosts = checkpoint(judge_hosts(judged, edges).where("blocked").select("of"))
    # pages of one host may be many: pages with a rule need no host's verdict, and Spark splits what is left
    ruled_pages = judged.where("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit("rule").alias("by"))
    others = judged.where("ruled IS NULL").join(hosts, F.col("host") == F.col("of"), "left")
    others = others.select("page_id", "host", "path", "rule", F.when(F.col("of").isNotNull(), "block").otherwise("allow").alias("verdict"), F.lit("graph").alias("by"))
    return ruled_pages.unionByName(others)
