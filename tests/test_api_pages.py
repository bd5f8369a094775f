import json

from pyspark.sql import functions as F

from tidemark.sources import api_pages as api


def test_code_events(spark):
    events = [
        {"id": "1", "type": "PushEvent", "repo": {"name": "o/r"}, "actor": {"login": "a"}, "payload": {"size": 2, "commits": [{"message": "Fix\nmore"}, {"message": "Two"}]}},
        {"id": "2", "type": "CreateEvent", "payload": {"ref_type": "branch"}}, {"id": "3", "type": "WatchEvent", "repo": {"name": "o/r"}}, {"id": "4", "type": ""},
    ]
    rows = api.code_events(spark.createDataFrame([("me", 1, json.dumps(events))], "endpoint_id string, page int, body string")).collect()
    assert [r["title"] for r in rows] == ["Fix — o/r", "Created branch in me", "Watch in o/r"]
    assert rows[0]["metrics"] == {"commit_count": 2.0} and rows[1]["metrics"] == {} and rows[0]["body"] == "Fix\nmore\nTwo" and rows[0]["next_cursor"] is None
    assert tuple(rows[0].asDict()) == api.FIELDS


def test_forum_and_author_posts(spark):
    listing = {"data": {"after": "t3_x", "children": [{"data": {"name": "t3_a", "title": "T", "permalink": "/r/p", "score": 3, "num_comments": 0, "created_utc": 5.0, "removed_by_category": "moderator"}}]}}
    row = api.forum_posts(spark.createDataFrame([("s", json.dumps(listing))], "endpoint_id string, body string")).first()
    assert (row["deletion_state"], row["metrics"], row["next_cursor"], row["canonical_url"]) == ("deleted", {"score": 3.0, "comments": 0.0}, "t3_x", "https://www.reddit.com/r/p")
    feed = {"feed": [{"post": {"uri": "at://d/x/k1", "cid": "c", "likeCount": 2, "author": {"did": "d", "handle": "h"}, "record": {"text": "\nOne\nTwo", "createdAt": "t"}}}]}
    row = api.author_posts(spark.createDataFrame([("s", json.dumps(feed))], "endpoint_id string, body string")).first()
    assert (row["title"], row["author"], row["canonical_url"]) == ("One", "h", "https://bsky.app/profile/d/post/k1")
    assert row["metrics"] == {"likes": 2.0, "reposts": 0.0, "replies": 0.0} and row["next_cursor"] is None


def test_paper_query(spark):
    urls = {"https://e.org/x?search_query=cat": "cat", "https://e.org/abs/12.3": "paper:12.3", "https://e.org/list/cs.CL/new": "cat:cs.CL", "https://e.org/": "all:*"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", api.paper_query(F.col("u")).alias("q")).collect()
    assert {r["u"]: r["q"] for r in rows} == urls
