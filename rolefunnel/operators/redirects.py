"""Where chains of redirects end, by pointer doubling.

Every address first points one hop ahead; each round replaces the pointer by the
pointer of the address it points to, so a chain of n hops takes log2(n) rounds of
one join.  An address that has reached the end leaves the rounds.  When a round
brings nobody to an end, whoever is left runs in a circle: on a chain longer than
the rounds reach there is always an address that is just near enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefunnel.session import cut_lineage

RESOLVED_DDL = "url string, target string, hops bigint, looped boolean"


def one_hop(redirects: DataFrame) -> DataFrame:
    """(url, final_url), one per address: the smallest address of several, none to itself."""
    real = redirects.filter(F.col("url").isNotNull() & F.col("final_url").isNotNull() & (F.col("url") != F.col("final_url")))
    return real.groupBy("url").agg(F.min("final_url").alias("final_url"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(url, target, hops, looped) of every address of ``redirects`` (url, final_url) that leads on.

    Addresses that run into a circle have no target.
    """
    hops = cut_lineage(one_hop(redirects))
    ends = hops.select(F.col("url").alias("_next"))
    # Who points to an address that leads nowhere is done; only the others go on.
    marked = cut_lineage(
        hops.join(ends, F.col("final_url") == F.col("_next"), "left").select("url", F.col("final_url").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.col("_next").isNull().alias("done"))
    )
    done, open_ = marked.filter("done").drop("done"), marked.filter("NOT done").drop("done")
    finished = [done]
    while not open_.isEmpty():
        ahead = open_.withColumn("over", F.lit(False)).unionByName(done.withColumn("over", F.lit(True)))
        ahead = ahead.select(F.col("url").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), "over")
        state = cut_lineage(open_.join(ahead, "at").select("url", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), "over"))
        now = state.filter("over").drop("over")
        open_ = state.filter("NOT over").drop("over")
        if now.isEmpty():  # the rest runs in circles
            break
        done = done.unionByName(now)
        finished.append(now)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    ended = out.select("url", F.col("at").alias("target"), "hops", F.lit(False).alias("looped"))
    return ended.unionByName(open_.select("url", F.lit(None).cast("string").alias("target"), F.lit(None).cast("bigint").alias("hops"), F.lit(True).alias("looped")))


def follow(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Landed pages (url, final_url, html) joined to the addresses that lead to them.

    Adds a row for every address of ``redirects`` whose chain ends at the address of
    a landed page, so that links to it find that page.
    """
    ended = resolve_redirects(redirects).filter("NOT looped").select(F.col("url").alias("_from"), F.col("target").alias("url"))
    led = pages.join(ended, "url").select(F.col("_from").alias("url"), "final_url", "html")
    return pages.select("url", "final_url", "html").unionByName(led)
