"""URL filters: host and path rules first, then trust and distrust spread over the link graph.

Only DataFrame functions run here. Trust is personalised PageRank from the hosts of
allowed pages along links; distrust is the same from the hosts of blocked pages against
links (who links to a blocked host shares its distrust). Ranks live in Spark tables; each
step is one join with the pre-aggregated host edges and one sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import ascii_lower, durable

#: The rules of the registered query: verdict and host with the path's beginning.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null. `rules` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, counted: src, dst, n. Links inside a host are no evidence."""
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(_HREF), F.lit(1)))
    found = pages.select(F.col("host").alias("src"), link.alias("link")).select(
        "src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst")
    )
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, follow: float, tolerance: float = 1e-9) -> DataFrame:
    """Ranks (kind, host, rank) from seeds (kind, host, seed), spread until they settle.

    `edges` is (kind, src, dst, n). A host hands on the part `follow` of its rank in
    proportion to n. Rounds end when no host's rank grows by more than `tolerance` times
    itself, so small ranks count like large ones and every host that links reach is
    reached, however far: as many rounds as that takes, for what is handed on shrinks with each. Sums are rounded to 12 significant digits, so that reruns agree.
    """
    if not 0 <= follow < 1:
        raise ValueError("follow must lie in [0, 1), or ranks never settle")
    totals = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = durable(edges.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    base = seeds.select("kind", "host", (F.col("seed") * (1 - follow)).alias("rank"), F.lit(0.0).alias("old"))
    ranks = durable(base)
    while True:
        moved = shares.join(ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * follow).alias("rank"), F.lit(0.0).alias("old")
        )
        before = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        rank = F.format_string("%.11e", F.sum("rank")).cast("double")
        ranks = durable(base.unionByName(moved).unionByName(before).groupBy("kind", "host").agg(rank.alias("rank"), F.sum("old").alias("old")))
        if ranks.where(F.abs(F.col("rank") - F.col("old")) > F.col("rank") * tolerance).isEmpty():
            return ranks.drop("old")


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]] | None = None, follow: float = 0.85, block_over: float = 1.0, salts: int = 16, tolerance: float = 1e-9
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A rule's verdict holds where one fits; elsewhere a host whose distrust is over
    `block_over` times its trust is blocked and any other allowed. Seeds are each
    host's share of the pages that rules allow and of those that rules block. A null
    url, or one without `://`, has an empty host and path, fits no rule, has no
    rank and is allowed; a null html has no links. Repeated rows give repeated
    rows and count as often as seeds. The host of a third of all pages is joined
    over `salts` parts.
    """
    rules = RULES if rules is None else rules
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = own.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = (
        judged.where("fit is not null and host <> ''")
        .groupBy(F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count("*").alias("pages"))
    )
    seeds = durable(seeds)
    totals = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("pages") / F.col("all")).alias("seed"))
    forward = durable(host_edges(own))
    edges = forward.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        forward.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    ranks = spread(edges, seeds, follow, tolerance)
    scores = ranks.groupBy("host").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust"))
    )
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = judged.drop("html").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return by.join(salted, ["host", "salt"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(distrust > trust * block_over, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
