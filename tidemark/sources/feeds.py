"""Feeds, outlines and API pages parsed into item candidates; every reader takes a table of raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATE = "external_id string, canonical_url string, title string, author string, published string, summary string"
RSS = "channel struct<title:string, link:string, description:string, item:array<struct<guid:string, link:string, title:string, author:string, pubDate:string, description:string>>>"
ATOM = "title string, entry array<struct<id:string, title:string, updated:string, summary:string, author:struct<name:string>, link:array<struct<_href:string, _rel:string>>>>"
JSON_FEED = "items array<struct<id:string, url:string, title:string, date_published:string, summary:string, author:struct<name:string>>>"
#: Names that hint at a secret; attributes named so never leave or enter.
SECRET = "token|key|secret|signature|auth|session|code|credential|password"


def _kept(found: DataFrame, key: str, most: int) -> DataFrame:
    return found.where(F.col("place") < most).drop("place") if most else found.drop("place")


def rss(raw: DataFrame, most: int = 30) -> DataFrame:
    """source_id and candidates of RSS text (source_id, body): the first `most` entries; id falls back from guid to link to title|date."""
    parsed = raw.select("source_id", F.from_xml("body", RSS).alias("x")).select("source_id", F.posexplode("x.channel.item").alias("place", "i"))
    key = F.coalesce(F.nullif(F.col("i.guid"), F.lit("")), F.nullif(F.col("i.link"), F.lit("")), F.concat_ws("|", "i.title", "i.pubDate"))
    return _kept(parsed.select("source_id", "place", key.alias("external_id"), F.col("i.link").alias("canonical_url"), F.col("i.title").alias("title"), F.col("i.author").alias("author"), F.col("i.pubDate").alias("published"), F.col("i.description").alias("summary")), "external_id", most)


def atom(raw: DataFrame, most: int = 30) -> DataFrame:
    """Candidates of Atom text; the link is the first without rel or with rel=alternate."""
    parsed = raw.select("source_id", F.from_xml("body", ATOM, {"attributePrefix": "_"}).alias("x")).select("source_id", F.posexplode("x.entry").alias("place", "e"))
    link = F.filter("e.link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))[0]["_href"]
    return _kept(parsed.select("source_id", "place", F.coalesce("e.id", link).alias("external_id"), link.alias("canonical_url"), F.col("e.title").alias("title"), F.col("e.author.name").alias("author"), F.col("e.updated").alias("published"), F.col("e.summary").alias("summary")), "external_id", most)


def json_feed(raw: DataFrame, most: int = 30) -> DataFrame:
    parsed = raw.select("source_id", F.from_json("body", JSON_FEED).alias("x")).select("source_id", F.posexplode("x.items").alias("place", "i"))
    return _kept(parsed.select("source_id", "place", F.coalesce("i.id", "i.url").alias("external_id"), F.col("i.url").alias("canonical_url"), F.col("i.title").alias("title"), F.col("i.author.name").alias("author"), F.col("i.date_published").alias("published"), F.col("i.summary").alias("summary")), "external_id", most)


def unseen(candidates: DataFrame, cursor: DataFrame) -> DataFrame:
    """Candidates whose id the cursor (source_id, external_id) has not seen."""
    return candidates.join(cursor.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")


OUTLINE = "struct<_text:string, _title:string, _xmlUrl:string, _htmlUrl:string"


def _depth(raw: DataFrame) -> int:
    """The deepest nesting of outlines in the table."""
    tags = F.regexp_extract_all("body", F.lit("(?i)<outline\\b[^>]*[^/]>|</outline>|<outline\\b[^>]*/>"), F.lit(0))
    step = lambda x: F.when(x.startswith("</"), -1).when(x.endswith("/>"), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = F.aggregate(tags, start, lambda a, x: F.struct((a["now"] + step(x)).alias("now"), F.greatest(a["most"], a["now"] + F.greatest(step(x), F.lit(0)) + x.endswith("/>").cast("int")).alias("most")))
    return raw.agg(F.max(walk["most"])).first()[0] or 1


def opml(raw: DataFrame, depth: int | None = None) -> DataFrame:
    """source_id, path, title, xml_url, html_url of OPML text; folders nest as deep as the text has them, or up to `depth` levels."""
    depth = depth or _depth(raw)
    kind = f"{OUTLINE}>"
    for _ in range(depth - 1):
        kind = f"{OUTLINE}, outline:array<{kind}>>"
    parsed = raw.select("source_id", F.from_xml("body", f"body struct<outline:array<{kind}>>", {"attributePrefix": "_"}).alias("x"))
    level = parsed.select("source_id", F.lit("").alias("path"), F.explode("x.body.outline").alias("o"))
    feeds = []
    for left in range(depth, 0, -1):
        title = F.coalesce("o._title", "o._text")
        feeds.append(level.where("o._xmlUrl is not null").select("source_id", "path", title.alias("title"), F.col("o._xmlUrl").alias("xml_url"), F.col("o._htmlUrl").alias("html_url")))
        if left > 1:
            level = level.where("o._xmlUrl is null").select("source_id", F.concat("path", F.lit("/"), title).alias("path"), F.explode("o.outline").alias("o"))
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


def to_opml(feeds: DataFrame) -> DataFrame:
    """One OPML line for each feed, in the order of path and title, escaped; secret-like query values are removed."""
    url = F.regexp_replace("xml_url", f"(?i)([?&][^=&]*(?:{SECRET})[^=&]*)=[^&]*", "$1=")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return feeds.select("path", "title", F.concat(F.lit('<outline type="rss" text="'), escaped(F.col("title")), F.lit('" xmlUrl="'), escaped(url), F.lit('"/>')).alias("line")).orderBy("path", "title")
