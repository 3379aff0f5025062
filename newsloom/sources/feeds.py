"""Feeds: stored bodies of RSS, Atom and news sitemaps to articles.

Two gates come first: the body must be well-formed, and its root known. Bodies that fail are
reported by source, so an empty feed and a broken one differ.
"""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from newsloom.functions import text as T
from newsloom.functions.dates import feed_date
from newsloom.operators.articles import credited

TEXT = "struct<_VALUE: string, _type: string>"
MEDIA = "array<struct<_url: string, _type: string>>"
RSS = f"channel struct<item: array<struct<guid: {TEXT}, title: string, link: string, description: string, pubDate: string, `dc:creator`: string, author: string, source: struct<_VALUE: string, _url: string>, enclosure: {MEDIA}, `media:content`: {MEDIA}, `media:thumbnail`: {MEDIA}, `content:encoded`: string>>>"
ATOM = f"entry array<struct<id: string, title: {TEXT}, link: array<struct<_rel: string, _href: string>>, published: string, updated: string, summary: {TEXT}, content: {TEXT}, author: array<struct<name: string>>, `media:thumbnail`: {MEDIA}>>"
SITEMAP = "url array<struct<loc: string, `news:news`: struct<`news:title`: string, `news:publication_date`: string>, `image:image`: array<struct<`image:loc`: string>>>>"
#: A fixed value: the path segment that tells sports stories.
SPORTS_PATH = "/sports/"
ARTICLE = ("source", "id", "title", "link", "description", "author", "published", "image_url", "tier", "reach", "scope", "pos")


@pandas_udf(BooleanType())
def well_formed(bodies: pd.Series) -> pd.Series:
    """Is each body well-formed XML? Declarations of entities are refused."""

    def refuse(*_):
        raise ValueError("entity declaration")

    def test(body):
        parser = expat.ParserCreate()
        parser.EntityDeclHandler = refuse
        try:
            parser.Parse(body or "", True)
        except (expat.ExpatError, ValueError):
            return False
        return True

    return bodies.map(test).astype(bool)


def root_of(body: Column) -> Column:
    """rss, atom or sitemap by the root element; null for anything else, a sitemap index too."""
    root = F.lower(F.regexp_extract(body, r"(?s)^﻿?\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<([A-Za-z_][\w.:-]*)", 1))
    return F.when(root.isin("rss", "channel"), "rss").when(root == "feed", "atom").when(root == "urlset", "sitemap")


def gated(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass with their format, and the names of sources that don't."""
    rows = fetched.withColumn("format", F.when(well_formed("body"), root_of(F.col("body"))))
    return rows.where("format IS NOT NULL"), rows.where("format IS NULL").select(F.col("name").alias("failed_source"))


def _xml(schema: str) -> Column:
    return F.from_xml("body", schema, {"mode": "PERMISSIVE"})


def _image_of(media: Column) -> Column:
    return F.get(F.filter(media, lambda m: m["_url"].isNotNull() & (m["_type"].isNull() | m["_type"].startswith("image/"))), F.lit(0))["_url"]


def decoded(text) -> Column:
    """Trimmed, references decoded, null if nothing is left; tags and white space within stay, as titles and bylines have no markup."""
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(T.decode_entities(T.trim_blanks(text)), F.lit(""))


def rss_articles(rows: DataFrame) -> DataFrame:
    item = rows.withColumn("_x", _xml(RSS)).select("*", F.posexplode("_x.channel.item").alias("pos", "i"))
    body = F.coalesce("i.`content:encoded`", "i.description")
    title, link = decoded("i.title"), T.blank_to_null(F.col("i.link"))
    image = F.coalesce(
        _image_of(F.col("i.enclosure")), F.get("i.`media:content`", F.lit(0))["_url"], F.get("i.`media:thumbnail`", F.lit(0))["_url"],
        T.first_image(F.col("i.`content:encoded`")), T.first_image(F.col("i.description"))
    )
    out = item.select(
        F.col("name").alias("source"), F.coalesce("i.guid._VALUE", "i.link").alias("id"), title.alias("title"), link.alias("link"), T.strip_tags(F.coalesce("i.description", body)).alias("description"),
        decoded(F.coalesce("i.`dc:creator`", "i.author")).alias("author"), feed_date(F.col("i.pubDate")).alias("published"), image.alias("image_url"),
        "tier", "reach", "scope", "pos", decoded("i.source._VALUE").alias("item_source"),
    )
    return credited(out.where("title IS NOT NULL AND link IS NOT NULL")).select(*ARTICLE)


def atom_link(links: Column) -> Column:
    """The first link without rel or an alternate one, else any with an href."""
    has = F.filter(links, lambda x: x["_href"].isNotNull())
    return F.coalesce(F.get(F.filter(has, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), F.lit(0))["_href"], F.get(has, F.lit(0))["_href"])


def atom_articles(rows: DataFrame) -> DataFrame:
    entry = rows.withColumn("_x", _xml(ATOM)).select("*", F.posexplode("_x.entry").alias("pos", "e"))
    teaser = F.coalesce("e.summary._VALUE", "e.content._VALUE")
    out = entry.select(
        F.col("name").alias("source"), F.coalesce("e.id", atom_link(F.col("e.link"))).alias("id"), decoded("e.title._VALUE").alias("title"), atom_link(F.col("e.link")).alias("link"), T.strip_tags(teaser).alias("description"),
        decoded(F.get("e.author", F.lit(0))["name"]).alias("author"), feed_date(F.coalesce("e.published", "e.updated")).alias("published"),
        F.coalesce(F.get("e.`media:thumbnail`", F.lit(0))["_url"], T.first_image(F.col("e.content._VALUE")), T.first_image(teaser)).alias("image_url"), "tier", "reach", "scope", "pos",
    )
    return credited(out.where("title IS NOT NULL AND link IS NOT NULL").withColumn("item_source", F.lit(None).cast("string"))).select(*ARTICLE)


def sitemap_articles(rows: DataFrame) -> DataFrame:
    url = rows.withColumn("_x", _xml(SITEMAP)).select("*", F.posexplode("_x.url").alias("pos", "u"))
    loc, title = T.squash(F.col("u.loc")), T.blank_to_null(T.decode_entities("u.`news:news`.`news:title`"))
    out = url.select(
        F.col("name").alias("source"), loc.alias("id"), title.alias("title"), loc.alias("link"), F.lit("").alias("description"), F.lit(None).cast("string").alias("author"),
        feed_date(F.col("u.`news:news`.`news:publication_date`")).alias("published"), F.get("u.`image:image`", F.lit(0))["image:loc"].alias("image_url"), "tier", "reach", "scope", "pos",
    )
    return credited(out.where("title IS NOT NULL").where(F.col("link").rlike(SPORTS_PATH)).withColumn("item_source", F.lit(None).cast("string"))).select(*ARTICLE)


MAPPERS = {"rss": rss_articles, "atom": atom_articles, "sitemap": sitemap_articles}


def articles_of(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All articles of fetched feeds (name, tier, reach, scope, body), and the sources that failed."""
    good, failed = gated(fetched)
    out = None
    for kind, mapper in MAPPERS.items():
        rows = mapper(good.where(F.col("format") == kind))
        out = rows if out is None else out.unionByName(rows)
    return out, failed
