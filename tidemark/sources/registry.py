"""Connectors by kind: what reads a landed page, and how a refresh moves its cursor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import api_pages, feeds

#: Entries of a feed that a refresh reads; its cursor remembers these.
READ = 30


@dataclass(frozen=True)
class Connector:
    """family: the form of its cursor. read(raw, most) gives candidates of landed bodies, the first `most` of each (0: all)."""

    kind: str
    family: str
    read: Callable[[DataFrame, int], DataFrame]


def _paged(parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    return lambda raw, most: parse(raw)


REGISTRY = {
    c.kind: c
    for c in (
        Connector("rss", "feed-seen-v1", feeds.rss), Connector("atom", "feed-seen-v1", feeds.atom), Connector("jsonFeed", "feed-seen-v1", feeds.json_feed),
        Connector("github", "page-v1", _paged(api_pages.code_events)), Connector("githubReleases", "release-page-v1", _paged(api_pages.code_releases)), Connector("reddit", "after-v1", _paged(api_pages.forum_posts)), Connector("bluesky", "opaque-v1", _paged(api_pages.author_posts)),
    )
}


def refresh(kind: str, raw: DataFrame, cursor: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, next cursor) of landed bodies; KeyError for a kind that nothing reads.

    Feeds: cursor (source_id, external_id) holds the ids seen; what it holds is dropped, and the next one holds the ids that
    were read now, so that an entry further down is delivered once it moves up. Pages: the next cursor is (endpoint_id, next_cursor, reached_end), null
    where there is no further page.
    """
    connector = REGISTRY[kind]
    found = connector.read(raw, READ)
    if connector.family == "feed-seen-v1":
        return (feeds.unseen(found, cursor) if cursor is not None else found), found.select("source_id", "external_id").distinct()
    last = found.groupBy("endpoint_id").agg(F.max("next_cursor").alias("next_cursor"))
    return found, last.withColumn("reached_end", F.col("next_cursor").isNull())
