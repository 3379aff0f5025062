"""Near-duplicate clustering of headlines.

Pairs are found and scored by joins: headlines within the window meet by a shared token, in
bands of time. Which are accepted depends on order: newest first, each unassigned row takes
the pairs it may, and they are gone. That goes in slabs of rows, in their order, of a bounded number
of pairs each; a slab is settled again where what it was told of the others has changed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.shared import stored

from . import tiles
from .order import numbered

#: Links that lead to a slab of nodes, about, and the slabs that are settled again in a round.
SLAB, AT_ONCE = 1 << 20, 16
WINDOW_HOURS, SIMILAR, RARE_SHARE, FEWEST, FLOOR, MOST_ROWS = 36, 0.55, 0.5, 15, 0.05, 1500


class Words(NamedTuple):
    """What callers know of a language: stopwords, labels before a colon, and pairs of terms that can't be one story."""

    stopwords: tuple = ()
    prefixes: tuple = ()
    opposed: tuple = ()


def tokens_of(articles: DataFrame, words: Words = Words()) -> DataFrame:
    """feed, link, token: distinct tokens of each title."""
    tokens = T.title_tokens(F.col("title"), F.col("source"), words.stopwords, words.prefixes)
    return articles.select("feed", "link", F.explode(F.array_distinct(tokens)).alias("token"))


def weights_of(tokens: DataFrame) -> DataFrame:
    """feed, token, df, weight: inverse document frequency in the feed, at least FLOOR; 1 in feeds of under FEWEST titles."""
    n = tokens.groupBy("feed").agg(F.count_distinct("link").alias("n"))
    df = tokens.groupBy("feed", "token").agg(F.count("*").alias("df"))
    weight = F.when(F.col("n") < FEWEST, F.lit(1.0)).otherwise(F.greatest(F.log(F.col("n") / (1 + F.col("df"))), F.lit(FLOOR)))
    return df.join(n, "feed").select("feed", "token", "df", "n", weight.alias("weight"))


def upper_median(weights: DataFrame) -> DataFrame:
    """feed, median: the weight at half the count of tokens, rounded down, from 0; null (nothing is rare) in small feeds."""
    order = Window.partitionBy("feed").orderBy("weight")  # of distinct weights, which are as few as distinct counts
    counted = weights.groupBy("feed", "weight").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    ranked = counted.withColumns({"upto": F.sum("c").over(order), "half": F.floor(F.sum("c").over(Window.partitionBy("feed")) / 2)})
    return ranked.where("upto > half AND upto - c <= half").select("feed", F.when(F.col("n") >= FEWEST, F.col("weight")).alias("median"))


def opposed(a: Column, b: Column, terms=()) -> Column:
    """Does one side have one term of a pair and the other side the other; a side with both doesn't count."""
    only = lambda side, x, y: F.array_contains(side, x) & ~F.array_contains(side, y)
    out = F.lit(False)
    for x, y in terms:
        out = out | (only(a, x, y) & only(b, y, x)) | (only(a, y, x) & only(b, x, y))
    return out


def pair_scores(articles: DataFrame, words: Words = Words(), least_shared: int = 3, least_dice: float = 0.0) -> DataFrame:
    """feed, anchor, link, shared, rare_shared, rare_least, dice: pairs of dated titles, newer first, with ``least_shared`` tokens in common or two rare ones.

    Without ``least_dice`` all titles that are near in time are counted with each other, in tiles (``tiles.pairs_of``).

    With it, just pairs of that weighted similarity or more are found. A pair shares a token that is not among the last ``least_shared - 1`` of either title, tokens put in order of their
    number of titles and then of the token; or a rare token. So titles meet by those tokens only, and common ones, which very
    many titles have, bring no pairs together on their own. All that a pair shares is then counted from the two titles.

    What a pair shares is at most what either title weighs from the first
    token that both have on; titles meet by tokens from which on that is enough for the pair, and by none that leave too little for any.
    """
    tokens = tokens_of(articles, words)
    weights = weights_of(tokens)
    rare = weights.join(upper_median(weights), "feed").select("feed", "token", "df", "weight", F.coalesce(F.col("weight") >= F.col("median"), F.lit(False)).alias("rare"))
    onward = Window.partitionBy("feed", "link").orderBy(F.desc("df"), F.desc("token"))  # of one title's tokens
    weighed = tokens.join(rare, ["feed", "token"]).withColumn("rest", F.sum("weight").over(onward))
    listed = weighed.groupBy("feed", "link").agg(F.array_sort(F.collect_list(F.struct("df", "token", "weight", "rare", "rest"))).alias("all"), F.max("rest").alias("total"))
    titles = listed.withColumn("tokens", F.transform("all", lambda t: F.struct(t["df"].alias("df"), t["token"].alias("token"), t["weight"].alias("weight"), t["rare"].alias("rare"))))
    dated = articles.where("published IS NOT NULL").select("feed", "link", "published")
    rows = titles.join(dated, ["feed", "link"]).withColumn("band", F.floor(F.unix_seconds("published") / (WINDOW_HOURS * 3600)))
    if not least_dice:
        slim = F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), t["weight"].alias("weight"), t["rare"].alias("rare")))
        return tiles.pairs_of(stored(rows.select("feed", "link", "published", "band", slim.alias("tokens")), "titles"), WINDOW_HOURS, least_shared)
    rows = stored(rows, "titles")
    n, least = F.size("all"), F.lit(least_dice - 1e-9)  # sums of weights differ by their order
    enough = lambda t: t["rest"] * (2 - least) >= F.col("total") * least
    meets = F.filter("all", lambda t, i: ((i <= n - least_shared) | t["rare"]) & enough(t))
    keyed = rows.select("feed", "link", "published", "band", "total", F.explode(meets).alias("t")).select("feed", "link", "published", "band", "total", "t.token", "t.rest")
    older = keyed.select("feed", "token", "link", F.col("published").alias("at"), "total", "rest", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    newer = keyed.select(
        "feed", "token", F.col("link").alias("anchor"), F.col("published").alias("anchor_at"), F.col("total").alias("anchor_total"), F.col("rest").alias("anchor_rest"), "band"
    )
    near = (F.unix_seconds("anchor_at") - F.unix_seconds("at")).between(0, WINDOW_HOURS * 3600)
    ordered = (F.col("anchor_at") > F.col("at")) | (F.col("anchor") < F.col("link"))
    alike = 2 * F.least("rest", "anchor_rest") >= least * (F.col("total") + F.col("anchor_total"))
    met = newer.join(older, ["feed", "token", "band"]).where(near & ordered & alike).select("feed", "anchor", "link").distinct()
    side = lambda name, c: rows.select("feed", F.col("link").alias(name), F.col("tokens").alias(c))
    both = met.join(side("anchor", "a"), ["feed", "anchor"]).join(side("link", "b"), ["feed", "link"])
    common = both.withColumn("c", F.array_intersect("a", "b"))
    weigh = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, t: acc + t["weight"])
    rares = lambda c: F.size(F.filter(c, lambda t: t["rare"]))
    counted = common.select(
        "feed", "anchor", "link", F.size("c").alias("shared"), rares("c").alias("rare_shared"), F.least(rares("a"), rares("b")).alias("rare_least"),
        (2 * weigh("c") / (weigh("a") + weigh("b"))).alias("dice")
    )
    return counted.where(((F.col("shared") >= least_shared) | (F.col("rare_shared") >= 2)) & (F.col("dice") >= least_dice))


def accepted(pairs: DataFrame, articles: DataFrame, words: Words = Words()) -> DataFrame:
    """Pairs that may merge."""
    enough = (F.col("rare_shared") >= 2) | (F.col("shared") >= 3)
    rare = (F.col("rare_least") == 0) | (F.col("rare_shared") / F.col("rare_least") >= RARE_SHARE)
    likely = pairs.where(enough & rare & (F.col("dice") >= SIMILAR))
    if not words.opposed:
        return likely.select("feed", "anchor", "link")
    sets = tokens_of(articles, words).groupBy("feed", "link").agg(F.collect_set("token").alias("tokens"))
    a = sets.select("feed", F.col("link").alias("anchor"), F.col("tokens").alias("ta"))
    both = likely.join(a, ["feed", "anchor"]).join(sets, ["feed", "link"])
    return both.where(~opposed(F.col("ta"), F.col("tokens"), words.opposed)).select("feed", "anchor", "link")


def lead_order(published: Column) -> Column:
    """A stamp of midnight stands for the day, so it goes to its end; no stamp goes last."""
    return F.when(F.date_trunc("day", published) == published, published + F.expr("INTERVAL 86399.999 SECONDS")).otherwise(published)


def placed(articles: DataFrame) -> DataFrame:
    """feed, link, rank, pos: places over all feeds from 0, and in the feed from 1, newest first."""
    ranked = numbered(articles.select("feed", "link", "published"), F.asc("feed"), F.desc_nulls_last("published"), F.asc("link"))
    return ranked.join(ranked.groupBy("feed").agg(F.min("rank").alias("start")), "feed").select(
        "feed", "link", "rank",
        (F.col("rank") - F.col("start") + 1).cast("int").alias("pos")
    )


def homes_of(links: DataFrame, slab: int = SLAB) -> DataFrame:
    """node, home for the nodes that an anchor takes. links: a, b, with a before b; in order, each node that none has taken is an
    anchor and takes all that it links to.

    So a node is an anchor if no anchor links to it. Nodes are dealt in their order to slabs that some ``slab`` links lead to, and a task settles a slab in one pass,
    told which of its nodes anchors of other slabs take. Where that changes by what is found there, slabs are settled again, the first ``AT_ONCE`` at a time, until it doesn't: then all is as
    defined, from the first slab on. There are at most as many rounds as slabs, however long the chains of nodes that wait for each other; the first anchor that links to a node has it.
    """

    def settled(rows: pa.Table) -> pa.Table:
        """slab, node: the anchors of a slab, in one pass over its nodes. rows: slab, kind (0: node b, 1: b is taken from without, 2: a links to b)."""
        kind, a, b = (rows.column(c).to_numpy() for c in ("kind", "a", "b"))
        nodes = np.unique(b[kind == 0])
        taken = np.zeros(len(nodes), bool)
        taken[np.searchsorted(nodes, b[kind == 1])] = True
        start, end = np.searchsorted(nodes, a[kind == 2]), np.searchsorted(nodes, b[kind == 2])
        end = end[np.argsort(start, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(nodes)))])
        for i in range(len(nodes)):
            if not taken[i]:
                taken[end[edges[i] : edges[i + 1]]] = True
        found = nodes[~taken]
        return pa.table({"slab": pa.array(np.full(len(found), rows.column("slab")[0].as_py()), pa.int64()), "node": pa.array(found, pa.int64())})

    ranked = numbered(links.select("a", "b").where("a < b").distinct(), F.asc("b"))
    part = stored(ranked.groupBy("b").agg(F.floor(F.min("rank") / slab).alias("slab")), "slabs")
    origin = part.select(F.col("b").alias("a"), F.col("slab").alias("origin"))
    dealt = stored(ranked.join(part, "b").join(origin, "a", "left").select("slab", "origin", "a", "b"), "dealt")
    inner = stored(dealt.where("origin = slab").select("slab", F.lit(2).alias("kind"), "a", "b").repartition("slab"), "inner")
    cross = stored(dealt.where("origin <> slab").select("slab", "a", "b"), "cross")
    first = stored(dealt.where("origin IS NULL").select("slab", "b").distinct(), "taken")  # nothing links to what links to them
    of_kind = lambda rows, kind: rows.select("slab", F.lit(kind).alias("kind"), F.col("b").alias("a"), "b")

    def anchors_of(taken, which=F.lit(True)):
        rows = of_kind(part, 0).unionByName(of_kind(taken, 1)).unionByName(inner).where(which)
        return rows.groupBy("slab").applyInArrow(settled, "slab long, node long")

    taken, anchors = first, stored(anchors_of(first), "anchors")
    while True:
        met = cross.join(anchors.select(F.col("node").alias("a")), "a").select("slab", "b")
        now = stored(first.unionByName(met).distinct(), "taken")
        other = now.join(taken, ["slab", "b"], "left_anti").unionByName(taken.join(now, ["slab", "b"], "left_anti"))
        again = [r.slab for r in other.select("slab").distinct().orderBy("slab").limit(AT_ONCE).collect()]
        if not again:
            break
        these = F.col("slab").isin(again)
        taken = stored(taken.where(~these).unionByName(now.where(these)), "taken")
        anchors = stored(anchors.where(~these).unionByName(anchors_of(taken, these)), "anchors")
    by_anchor = dealt.where("origin IS NULL").select("a", "b").unionByName(dealt.join(anchors.select(F.col("node").alias("a")), "a").select("a", "b"))
    return by_anchor.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("home"))


def clusters(articles: DataFrame, max_input: int | None = MOST_ROWS, words: Words = Words()) -> DataFrame:
    """feed, anchor, link, anchor_pos for every article: the cluster it is in by its newest member.

    articles: feed, link, title, source, published. Feeds of more than max_input rows stay unclustered;
    None clusters all.
    """
    size = articles.groupBy("feed").agg(F.count("*").alias("rows"))
    small = articles if max_input is None else articles.join(size.where(F.col("rows") <= max_input).select("feed"), "feed", "left_semi")
    pairs = accepted(pair_scores(small, words, least_dice=SIMILAR), small, words)
    listed = placed(articles)
    nodes = stored(listed.groupBy("feed", "link").agg(F.min("rank").alias("rank"), F.min("pos").alias("pos")), "nodes")
    at = lambda link, rank: nodes.select("feed", F.col("link").alias(link), F.col("rank").alias(rank))
    links = stored(pairs.join(at("anchor", "a"), ["feed", "anchor"]).join(at("link", "b"), ["feed", "link"]).select("a", "b"), "accepted")

    homes = homes_of(links).withColumnRenamed("node", "rank")
    homed = nodes.join(homes, "rank", "left").withColumn("home", F.coalesce("home", "rank"))
    anchors = nodes.select(F.col("rank").alias("home"), F.col("link").alias("anchor"), F.col("pos").alias("anchor_pos"))
    assigned = homed.join(anchors, "home").select("feed", "link", "anchor", "anchor_pos")
    return articles.select("feed", "link").join(assigned, ["feed", "link"]).select("feed", "anchor", "link", "anchor_pos")


def rolled_up(articles: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per cluster: lead, size, other sources in member order, latest time, in anchor order.

    The lead is the earliest; within five minutes a lower tier, then a beat writer, then the smaller link wins.
    That rule isn't transitive, so it folds over the members in order; clusters of one don't need it.
    """
    rows = articles.join(assigned, ["feed", "link"]).withColumn("lead_at", F.unix_micros(lead_order(F.col("published"))))
    rows = stored(rows.select("feed", "anchor", "link", "source", "tier", "reach", "published", "lead_at", "anchor_pos"), "members")
    several = stored(rows.groupBy("feed", "anchor").agg(F.count("*").alias("n")).where("n > 1").select("feed", "anchor"), "several")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["published", "link"], ascending=[False, True], na_position="last")
        best = None
        for r in rows.to_dict("records"):
            at = float("inf") if pd.isna(r["lead_at"]) else r["lead_at"]
            key = (r["tier"], r["reach"] != "beat", r["link"])
            if best is None or (key < best[1] if abs(at - best[0]) <= 300e6 or at == best[0] else at < best[0]):
                best = (at, key, r)
        lead = best[2]
        others = list(dict.fromkeys(s for s in rows["source"] if s != lead["source"]))
        return pd.DataFrame(
            [
                {
                    "feed": lead["feed"], "id": lead["link"], "lead": lead["link"], "duplicate_count": len(rows) - 1, "also_covered_by": others,
                    "latest_published_at": rows["published"].max(), "anchor_pos": lead["anchor_pos"]
                }
            ]
        )

    schema = "feed string, id string, lead string, duplicate_count int, also_covered_by array<string>, latest_published_at timestamp, anchor_pos int"
    folded = rows.join(several, ["feed", "anchor"], "left_semi").groupBy("feed", "anchor").applyInPandas(fold, schema)
    single = rows.join(several, ["feed", "anchor"], "left_anti")
    single = single.select(
        "feed", F.col("link").alias("id"), F.col("link").alias("lead"), F.lit(0).alias("duplicate_count"),
        F.array().cast("array<string>").alias("also_covered_by"), F.col("published").alias("latest_published_at"), "anchor_pos"
    )
    return single.unionByName(folded)


def leads_with_duplicates(rolled: DataFrame, articles: DataFrame) -> DataFrame:
    """The lead articles with what they have absorbed; order by anchor_pos for display."""
    return rolled.join(articles, (rolled["lead"] == articles["link"]) & (rolled["feed"] == articles["feed"])).drop(articles["feed"]).drop("lead")
