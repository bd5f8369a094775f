"""Landed API pages (endpoint_id, body as JSON) parsed into candidates, each with the cursor that follows the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("endpoint_id", "external_id", "canonical_url", "title", "author", "published", "body", "deletion_state", "metrics", "next_cursor")
_EVENTS = "array<struct<id:string, type:string, created_at:string, actor:struct<login:string, display_login:string>, repo:struct<name:string>, payload:struct<size:double, ref_type:string, commits:array<struct<message:string>>>>>"
_RELEASES = "array<struct<id:bigint, html_url:string, name:string, tag_name:string, body:string, created_at:string, published_at:string, updated_at:string, author:struct<login:string>>>"
_LISTING = "data struct<after:string, children:array<struct<data:struct<name:string, title:string, author:string, permalink:string, selftext:string, created_utc:double, score:double, num_comments:double, removed_by_category:string>>>>"
_POSTS = "cursor string, feed array<struct<post:struct<uri:string, cid:string, likeCount:double, repostCount:double, replyCount:double, author:struct<did:string, handle:string, displayName:string>, record:struct<text:string, createdAt:string>>>>"


def _metrics(**values: Column) -> Column:
    """A map of the metrics that are there."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def _first_line(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, "\n"), lambda x: x != "")[0], text)


def code_events(pages: DataFrame) -> DataFrame:
    """Repository events: title by event type, commit messages as body; pages (endpoint_id, page, body) of fifty."""
    rows = pages.select("endpoint_id", "page", F.from_json("body", _EVENTS).alias("all")).select("endpoint_id", F.when(F.size("all") >= 50, (F.col("page") + 1).cast("string")).alias("next_cursor"), F.explode("all").alias("e"))
    repo = F.coalesce("e.repo.name", "endpoint_id")
    bare = F.regexp_replace("e.type", "Event", "")
    message = _first_line(F.col("e.payload.commits")[0]["message"])
    # fixed values: titles by type of event
    title = (
        F.when(F.col("e.type") == "PushEvent", F.when(message.isNotNull(), F.concat(message, F.lit(" — "), repo)).otherwise(F.concat(F.lit("New commits in "), repo)))
        .when(F.col("e.type") == "ReleaseEvent", F.concat(F.lit("New release in "), repo)).when(F.col("e.type") == "IssuesEvent", F.concat(F.lit("Issue updated in "), repo))
        .when(F.col("e.type") == "PullRequestEvent", F.concat(F.lit("Pull request updated in "), repo))
        .when(F.col("e.type") == "CreateEvent", F.concat(F.lit("Created "), F.coalesce("e.payload.ref_type", F.lit("ref")), F.lit(" in "), repo))
        .otherwise(F.when(F.col("e.type") != "", F.concat(bare, F.lit(" in "), repo)))
    )
    body = F.array_join(F.transform("e.payload.commits", lambda c: c["message"]), "\n")
    made = rows.select("endpoint_id", F.col("e.id").alias("external_id"), F.concat(F.lit("https://github.com/"), repo).alias("canonical_url"), title.alias("title"), F.coalesce("e.actor.display_login", "e.actor.login").alias("author"), F.col("e.created_at").alias("published"), body.alias("body"), F.lit("available").alias("deletion_state"), _metrics(commit_count=F.col("e.payload.size")).alias("metrics"), "next_cursor")
    return made.where(F.col("title").isNotNull())


def code_releases(pages: DataFrame) -> DataFrame:
    """Releases: the name, or where that is empty the tag, as title; pages (endpoint_id, page, body) of twenty."""
    rows = pages.select("endpoint_id", "page", F.from_json("body", _RELEASES).alias("all")).select("endpoint_id", F.when(F.size("all") >= 20, (F.col("page") + 1).cast("string")).alias("next_cursor"), F.explode("all").alias("r"))
    title = F.coalesce(F.nullif("r.name", F.lit("")), "r.tag_name")
    made = rows.select(
        "endpoint_id", F.concat(F.lit("release:"), F.col("r.id").cast("string")).alias("external_id"), F.col("r.html_url").alias("canonical_url"), title.alias("title"), F.col("r.author.login").alias("author"),
        F.coalesce("r.published_at", "r.created_at").alias("published"), F.col("r.body").alias("body"), F.lit("available").alias("deletion_state"), F.create_map().cast("map<string,double>").alias("metrics"), "next_cursor",
        F.col("r.updated_at").alias("modified"), F.array(F.lit("release"), "r.tag_name").alias("topics"),
    )
    return made


def forum_posts(pages: DataFrame) -> DataFrame:
    """Forum listings; a post that moderators removed is deleted, not dropped."""
    rows = pages.select("endpoint_id", F.from_json("body", _LISTING).alias("x")).select("endpoint_id", F.col("x.data.after").alias("next_cursor"), F.explode("x.data.children.data").alias("p"))
    return rows.select("endpoint_id", F.col("p.name").alias("external_id"), F.concat(F.lit("https://www.reddit.com"), "p.permalink").alias("canonical_url"), F.col("p.title").alias("title"), F.col("p.author").alias("author"), F.col("p.created_utc").cast("long").cast("string").alias("published"), F.col("p.selftext").alias("body"), F.when(F.col("p.removed_by_category").isNull(), "available").otherwise("deleted").alias("deletion_state"), _metrics(score=F.col("p.score"), comments=F.col("p.num_comments")).alias("metrics"), "next_cursor")


def author_posts(pages: DataFrame) -> DataFrame:
    """Author feeds; the title is the first line, missing counts are 0."""
    rows = pages.select("endpoint_id", F.from_json("body", _POSTS).alias("x")).select("endpoint_id", F.col("x.cursor").alias("next_cursor"), F.explode("x.feed.post").alias("p"))
    link = F.concat(F.lit("https://bsky.app/profile/"), "p.author.did", F.lit("/post/"), F.element_at(F.split("p.uri", "/"), -1))
    count = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("endpoint_id", F.col("p.uri").alias("external_id"), link.alias("canonical_url"), _first_line(F.col("p.record.text")).alias("title"), F.coalesce("p.author.displayName", "p.author.handle").alias("author"), F.col("p.record.createdAt").alias("published"), F.col("p.record.text").alias("body"), F.lit("available").alias("deletion_state"), _metrics(likes=count("p.likeCount"), reposts=count("p.repostCount"), replies=count("p.replyCount")).alias("metrics"), "next_cursor")


def paper_query(url: Column) -> Column:
    """identity of a paper search address: its search, one paper, a category, or everything."""
    search = F.try_parse_url(url, F.lit("QUERY"), F.lit("search_query"))
    part = lambda kind: F.regexp_extract(url, f"://[^/]+/{kind}/([^/?#]+)", 1)
    return F.when(F.coalesce(search, F.lit("")) != "", search).when(part("abs") != "", F.concat(F.lit("paper:"), part("abs"))).when(part("list") != "", F.concat(F.lit("cat:"), part("list"))).otherwise("all:*")
