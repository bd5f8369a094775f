"""Queries of the text, hash, URL and policy functions over whole tables."""

from __future__ import annotations

from tidemark.functions import text as t
from tidemark.functions.urls import canonical_url_sql
from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query


def tokens_dedup(d: Dialect) -> str:
    """Tokens of the dedup variant, in order, as count and hash."""
    x = t.tokens_dedup(d, "plain_text")
    return f"SELECT item_id, {d.size('w')} AS n, {d.sha256(d.join('w', chr(39) + ' ' + chr(39)))} AS h FROM (SELECT item_id, {x} AS w FROM v_items) x"


def tokens_cluster(d: Dialect) -> str:
    """Token set of the clustering variant, as count and hash."""
    x = t.tokens_cluster(d, "plain_text")
    return f"SELECT item_id, {d.size('w')} AS n, {d.sha256(d.join('w', chr(39) + ' ' + chr(39)))} AS h FROM (SELECT item_id, {x} AS w FROM v_items) x"


def shingles(d: Dialect) -> str:
    """Distinct three-word shingles."""
    x = d.distinct(t.shingles(d, "w"))
    return f"SELECT item_id, {d.size('s')} AS n, {d.sha256(d.join('s', chr(39) + '|' + chr(39)))} AS h FROM (SELECT item_id, {x} AS s FROM (SELECT item_id, {t.tokens_dedup(d, 'plain_text')} AS w FROM v_items) y) x"


def char_trigrams(d: Dialect) -> str:
    """Character trigrams of each title."""
    x = t.char_grams(d, "lower(title)", 3)
    return f"SELECT item_id, {d.size('g')} AS n, {d.sha256(d.join('g', chr(39) + '|' + chr(39)))} AS h FROM (SELECT item_id, {x} AS g FROM v_items) x"


def char_bigrams(d: Dialect) -> str:
    """Distinct character bigrams without white space, of each conversation turn."""
    body = d.replace_all("lower(body)", r"\s+", "''")
    return f"SELECT item_id, ordinal, {d.size('g')} AS n, {d.sha256(d.join('g', chr(39) + '|' + chr(39)))} AS h FROM (SELECT item_id, ordinal, {d.distinct(t.char_grams(d, 'b', 2))} AS g FROM (SELECT item_id, ordinal, {body} AS b FROM v_revisions) y) x"


HAN_ROWS = [
    (1, "人工智能改变世界"), (2, "智能 手机 2024"), (3, "旧的报道：城市交通"), (4, "Mixed 中文 and English 新闻"), (5, "单"),
    (6, "plain latin text"), (7, "东京奥运会开幕 Tokyo"), (8, "智"), (9, "数据，科学。与工程"), (10, ""),
]


def _han(d: Dialect) -> str:
    return "(VALUES " + ", ".join(f"({i}, {d.text(x)})" for i, x in HAN_ROWS) + ") AS f(id, txt)"


def han_ngrams(d: Dialect) -> str:
    """Han runs with their one- and two-character grams, within a run only (no table at hand has Han text)."""
    one = f"{d.find_all('txt', t.HAN_RUN.rstrip('+'))}"
    flat = "flatten" if d.spark else "flatten"
    two = f"{flat}({d.map(d.find_all('txt', t.HAN_RUN), 'r', t.char_grams(d, 'r', 2))})"
    return f"SELECT id, {d.join(one, chr(39) + ' ' + chr(39))} AS unigrams, {d.join(two, chr(39) + ' ' + chr(39))} AS bigrams, {d.matches('txt', '^' + t.HAN_RUN.rstrip('+') + '{1,2}$')} AS is_short_query FROM {_han(d)}"


def sentence_summary(d: Dialect) -> str:
    """The first three sentences of 20 characters or more, joined by a full stop: a Han one without a space where the text is Han."""
    kept = d.filter(t.sentences(d, "plain_text"), "s", "length(s) >= 20")
    first = f"slice({kept}, 1, 3)" if d.spark else f"{kept}[1:3]"
    return f"SELECT item_id, {d.sha256(f"CASE WHEN {d.matches('plain_text', t.HAN)} THEN {d.join(first, chr(39) + '。' + chr(39))} ELSE {d.join(first, chr(39) + '. ' + chr(39))} END")} AS h, {d.size(first)} AS n FROM v_items"


def key_sentences(d: Dialect) -> str:
    """The three best sentences of each text by length, digits and attribution, in the order of the text."""
    score = f"least(1.0, length(s) / 180.0) + CASE WHEN {d.matches('s', '[0-9]')} THEN 0.12 ELSE 0.0 END + CASE WHEN {d.matches('lower(s)', '表示|said|according')} THEN 0.08 ELSE 0.0 END"
    return f"""SELECT item_id, place, {d.sha256("s")} AS sentence_hash, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) AS rn FROM (
            SELECT item_id, CAST(place AS BIGINT) AS place, s, {d.real(score)} AS score FROM {d.explode(f"(SELECT item_id, {t.sentences(d, 'plain_text')} AS ss FROM v_items)", "ss", "s", "place")}) y
        WHERE length(s) >= 20) x WHERE rn <= 3"""


def language_family(d: Dialect) -> str:
    """Language family by code and by script."""
    han, latin = d.size(d.find_all("plain_text", t.HAN)), d.size(d.find_all("plain_text", "[A-Za-z]"))
    return f"SELECT item_id, {t.language_family(d, 'language_code')} AS family, CASE WHEN {han} >= 8 AND {han} > {latin} / 8 THEN 'zh' WHEN {latin} >= 16 THEN 'en' ELSE 'unknown' END AS script_family FROM v_items"


def author_split(d: Dialect) -> str:
    """Authors split at list marks, 2 to 100 characters, sorted and distinct, none if over twelve."""
    parts = d.distinct(d.filter(d.map(d.split("names", "[,;、，；\\n]"), "a", "trim(a)"), "a", "length(a) BETWEEN 2 AND 100"))
    return f"SELECT item_id, CASE WHEN {d.size('a')} <= 12 THEN {d.join('a', chr(39) + '|' + chr(39))} END AS authors FROM (SELECT item_id, {parts} AS a FROM (SELECT item_id, replace(name, ' ', ', ') || '; ' || topic AS names FROM v_topics) y) x"


def content_hash(d: Dialect) -> str:
    """Hashes of content, of each part, and the cache key of seven parts."""
    sep = "chr(31)"
    return f"SELECT item_id, content_hash, {d.sha256('plain_text')} AS text_hash, {d.sha256(f'concat_ws({sep}, external_id, source_id, language_code, content_hash, title, external_id, source_id)')} AS cache_key, {d.n_bytes('plain_text')} AS n_bytes FROM v_items"


def stable_uuid(d: Dialect) -> str:
    """Name-based identifiers of contents, and the blob identifier of the same hash."""
    h = "content_hash"
    return f"SELECT item_id, {t.name_uuid(d, 'plain_text')} AS segment_id, concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12)) AS blob_id, concat(substr({h}, 1, 2), '/', substr({h}, 3, 2), '/', {h}) AS blob_path FROM v_items"


def url_canonicalize(d: Dialect) -> str:
    """Canonical URLs of pages."""
    if d.spark:
        return "SELECT page_id, canonical_url FROM (SELECT page_id, url, " + _spark_url("url") + " AS canonical_url FROM v_pages) x"
    return f"SELECT page_id, {canonical_url_sql('url')} AS canonical_url FROM v_pages"


def _spark_url(x: str) -> str:
    from tidemark.functions.urls import canonical_url_spark_sql

    return canonical_url_spark_sql(x)


def http_redaction(d: Dialect) -> str:
    """Header and query redaction: values whose name holds a secret fragment, or is one that the connector names, are replaced; user and fragment go.

    Headers are those of requests made from events: a name by the event's number, its properties as the value; clicks' connector names one of its own.
    """
    # fixed values: fragments of secret header and parameter names
    header = "authorization|cookie|api-key|apikey|access-token|session|csrf|xsrf|client-secret|signature"
    query = "token|key|secret|signature|sig|auth|session|code|credential|password"
    items = d.filter(d.split("regexp_extract(url, " + d.re(r"\?([^#]*)") + ", 1)", "&"), "q", "q <> ''")
    safe = d.map(items, "q", f"CASE WHEN {d.matches('lower(split_part(q, ' + chr(39) + '=' + chr(39) + ', 1))', query)} THEN split_part(q, '=', 1) || '=<redacted>' ELSE q END")
    names = ("Authorization", "Content-Type", "X-Api-Key", "Set-Cookie", "ETag", "My-Session-Id", "X-Own", "accept", "X-CSRF")
    named = f"CASE event_id % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
    rows = f"(SELECT event_id AS hid, {named} AS name, props AS v, event_type = 'click' AS names_own FROM events WHERE event_id IS NOT NULL) h"
    base = f"{d.replace_all('split_part(split_part(url, ' + chr(39) + '#' + chr(39) + ', 1), ' + chr(39) + '?' + chr(39) + ', 1)', '//[^/@]*@', chr(39) + '//' + chr(39))}"
    return f"""SELECT page_id, {base} || CASE WHEN {d.size(items)} > 0 THEN '?' || {d.join(safe, chr(39) + '&' + chr(39))} ELSE '' END AS safe_url, 'url' AS part FROM v_pages
        UNION ALL SELECT hid, CASE WHEN {d.matches('lower(name)', header)} OR (names_own AND lower(name) = 'x-own') THEN name || ': <redacted>' ELSE name || ': ' || coalesce(v, '') END, 'header' FROM {rows}"""


def meta_extract(d: Dialect) -> str:
    """Title by og:title, title or host; description by og:description or its meta; language by attribute."""
    get = lambda p: f"nullif(regexp_extract(html, {d.re(p)}, 1), '')"
    host = "regexp_extract(url, " + d.re("://([^/?#]+)") + ", 1)"
    og = 'property=["' + "\\x27" + ']og:title["' + "\\x27" + '] content=["' + "\\x27" + ']([^"]*)'
    return f"SELECT page_id, coalesce({get(og)}, {get('<title>([^<]*)</title>')}, {host}) AS title, coalesce({get(og.replace('title', 'description'))}, {get('name=.description. content=.([^">]*)')}) AS description, {get('<html lang=.([a-z]+)')} AS lang, {host} AS host FROM v_pages"


def plain_text_simple(d: Dialect) -> str:
    """Plain text without tags, scripts and styles; white space collapsed."""
    body = d.replace_all("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", "' '")
    body = d.replace_all(body, "(?s)<!--.*?-->", "' '")
    body = d.replace_all(body, "<[^>]*>", "' '")
    body = d.replace_all(body, r"[ \t\n\r]+", "' '")
    return f"SELECT page_id, {d.sha256(f'trim({body})')} AS h, CAST(length(trim({body})) AS BIGINT) AS n FROM v_pages"


def feed_autodiscovery(d: Dialect) -> str:
    """Feeds that each page names in alternate links, in order of appearance and resolved against its host, then the well-known paths.

    The pages at hand name none, so each has a head of its own in front: an RSS and a JSON feed, an icon and a translation.
    """
    base = "regexp_extract(url, " + d.re("^([a-z]+://[^/?#]+)") + ", 1)"
    head = "'<link rel=\"icon\" href=\"/i.png\"><LINK rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed-' || page_id || '.xml\"><link href=\"https://feeds.example.org/' || page_id || '\" type=\"application/feed+json\" rel=\"alternate home\"><link rel=\"alternate\" hreflang=\"de\" href=\"/de\">'"
    tags = d.find_all(f"({head} || html)", "(?i)<link [^>]*>")
    rel = "(?i)rel=.([^>]*[ \"])?alternate[ \"]"
    feeds = d.filter(tags, "t", f"{d.matches('t', rel)} AND {d.matches('lower(t)', 'type=.[^>]*(rss|atom|feed.json)')}")
    href = "regexp_extract(t, " + d.re('(?i)href="([^"]*)"') + ", 1)"
    links = d.map(feeds, "t", f"CASE WHEN {d.starts(href, chr(39) + '/' + chr(39))} THEN {base} || {href} ELSE {href} END")
    # fixed values: the well-known feed paths
    known = d.map(d.array(*[f"'{p}'" for p in ("/feed", "/feed.xml", "/rss", "/rss.xml", "/atom.xml", "/index.xml")]), "p", f"{base} || p")
    return f"SELECT page_id, {d.size(links)} AS links_n, {d.join(links, chr(39) + ' ' + chr(39))} AS links, {d.join(known, chr(39) + ' ' + chr(39))} AS known_paths FROM v_pages"


def connector_routing(d: Dialect) -> str:
    """Connectors to try by host (the host itself or one below it), in order, rss then website for all others; the first that succeeds, and how many fail before.

    What succeeds is made by page: a host's own connector for a third, rss for half, website for all but an eleventh.
    """
    host = "lower(regexp_extract(u, " + d.re("^[a-zA-Z]+://([^/:?#]+)") + ", 1))"
    sites = {"github.com": "github", "reddit.com": "reddit", "bsky.app": "bluesky", "arxiv.org": "arxiv", "news.ycombinator.com": "hackernews"}
    of = lambda h: f"({host} = '{h}' OR {'endswith' if d.spark else 'ends_with'}({host}, '.{h}'))"
    route = "CASE " + " ".join(f"WHEN {of(h)} THEN '{c},rss,website'" for h, c in sites.items()) + " ELSE 'rss,website' END"
    known = ", ".join(f"({-1 - i}, 'https://{x}')" for i, x in enumerate(("github.com/a/b", "notgithub.com/a", "export.arxiv.org/abs/1", "old.reddit.com/r/x", "bsky.app", "arxiv.org.example.net/x")))
    works = "CASE c WHEN 'rss' THEN page_id % 2 = 0 WHEN 'website' THEN page_id % 11 <> 0 ELSE page_id % 3 = 0 END"
    good = d.filter(d.split("route", ","), "c", works)
    tried = f"CASE WHEN {d.size('good')} > 0 THEN {d.at('good', '1')} END"
    before = f"CASE WHEN {d.size('good')} > 0 THEN CAST({'array_position' if d.spark else 'list_position'}({d.split('route', ',')}, {d.at('good', '1')}) AS BIGINT) - 1 ELSE {d.size(d.split('route', ','))} END"
    return f"SELECT page_id, route, host, {tried} AS chosen, {before} AS failures FROM (SELECT *, {good} AS good FROM (SELECT page_id, {route} AS route, {host} AS host FROM (SELECT page_id, url AS u FROM v_pages WHERE url IS NOT NULL UNION ALL SELECT page_id, u FROM (VALUES {known}) AS k(page_id, u)) x) y) z"


def public_url_policy(d: Dialect) -> str:
    """Only http(s) to hosts that are neither loopback, private, link-local nor local names."""
    rows = ["http://localhost/x", "https://127.0.0.1/a", "http://10.1.2.3/", "http://172.16.0.1/", "http://172.32.0.1/", "http://192.168.1.1/", "http://169.254.3.4/", "ftp://example.org/", "https://example.org/p", "http://printer.local/", "https://8.8.8.8/dns", "javascript:alert(1)"]
    urls = ", ".join(f"({i}, '{u}')" for i, u in enumerate(rows))
    host = "lower(regexp_extract(u, " + d.re("^https?://([^/:?#]+)") + ", 1))"
    private = r"^(127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
    return f"SELECT id, u, {host} <> '' AND {host} <> 'localhost' AND {host} NOT LIKE '%.local' AND NOT {d.matches(host, private)} AS is_public FROM (SELECT id, u FROM (VALUES {urls}) AS f(id, u) UNION ALL SELECT page_id + 1000, url FROM v_pages) x"


def retry_backoff(d: Dialect) -> str:
    """Status classes and the delay before the next attempt: 15 s doubled for each attempt, six hours at most."""
    rows = ", ".join(f"({s}, {a})" for s in (200, 304, 401, 403, 404, 429, 500, 503) for a in range(13))
    return f"""SELECT status, attempt, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rateLimited' WHEN status = 304 THEN 'notModified' ELSE 'failed' END AS class,
        CAST(least(21600, power(2, least(attempt, 10)) * 15) AS BIGINT) AS delay_s FROM (VALUES {rows}) AS f(status, attempt)"""


#: Days that raw fetches of each class are kept, null: for good.
RETENTION = {"publicRaw30Days": 30, "privateRaw7Days": 7, "failedExtraction30Days": 30, "publicDiagnostic30Days": 30, "privateDiagnostic7Days": 7, "cache30Days": 30, "durableEvidence": None, "savedOffline": None}


def retention_cutoff(d: Dialect) -> str:
    """Raw fetches of each retention class at a fixed moment: how many there are, its cut-off, and how many are older and expire."""
    now = d.now("2024-02-10 00:00:00")
    days = ", ".join(f"('{k}', {'CAST(NULL AS INT)' if v is None else v})" for k, v in RETENTION.items())
    string = "STRING" if d.spark else "VARCHAR"
    kind = f"CASE WHEN user_n % 11 = 0 THEN 'savedOffline' WHEN metric = 'error' THEN 'failedExtraction30Days' WHEN metric = 'purchase' THEN 'durableEvidence' WHEN metric = 'view' THEN 'cache30Days' WHEN metric = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'publicDiagnostic30Days' ELSE 'privateDiagnostic7Days' END WHEN event_id % 3 = 0 THEN 'privateRaw7Days' ELSE 'publicRaw30Days' END"
    return f"""SELECT c.name AS retention_class, {now} - c.days * 86400 AS cutoff, count(*) AS fetches, sum(CASE WHEN fetched_at < {now} - c.days * 86400 THEN 1 ELSE 0 END) AS expired
        FROM (SELECT CAST({kind} AS {string}) AS name, captured_at AS fetched_at FROM (SELECT event_id, metric, captured_at, item_id AS user_n FROM v_metrics) e) f JOIN (VALUES {days}) AS c(name, days) ON c.name = f.name GROUP BY c.name, c.days"""


def privacy_policy(d: Dialect) -> str:
    """Where content may be processed: local always; elsewhere by privacy class and grant."""
    return """SELECT s.source_id, p.location, CASE WHEN p.location = 'local' THEN TRUE WHEN s.ecosystem = 'unknown' THEN FALSE WHEN s.ecosystem = 'mixed' THEN g.source_id IS NOT NULL ELSE TRUE END AS allowed
        FROM v_sources s JOIN (VALUES ('local'), ('cloud')) AS p(location) ON TRUE LEFT JOIN (SELECT DISTINCT source_id FROM v_memberships WHERE decision = 'accepted' AND confidence > 0.99) g ON g.source_id = s.source_id"""


def fixed_times(d: Dialect) -> str:
    """Day keys, minutes and buckets of moments."""
    return f"SELECT event_id, CAST(floor(captured_at / 86400) AS BIGINT) AS day_n, CAST(floor(captured_at % 86400 / 60) AS BIGINT) AS minute_n, CAST(floor(captured_at / 1800) AS BIGINT) AS bucket, {d.real(t.clamp01('1 - abs(captured_at - ' + d.now('2024-01-20 00:00:00') + ') / 1209600.0'), 9)} AS decay FROM v_metrics"


def day_times(d: Dialect) -> str:
    """Moments as HH:mm keys of their day, and the keys of turns read back into minutes; what is no time of day is null."""
    two = lambda x: f"lpad(CAST({x} AS {'STRING' if d.spark else 'VARCHAR'}), 2, '0')"
    minute = "CAST(floor(captured_at % 86400 / 60) AS BIGINT)"
    key = f"concat({two(f'CAST(floor({minute} / 60.0) AS BIGINT)')}, ':', {two(f'{minute} % 60')})"
    said = f"CASE event_id % 5 WHEN 0 THEN concat(k, ' ') WHEN 1 THEN replace(k, ':', '-') WHEN 2 THEN concat('7', k) ELSE k END"
    parsed = f"CASE WHEN {d.matches('said', '^([01][0-9]|2[0-3]):[0-5][0-9]$')} THEN CAST(substr(said, 1, 2) AS BIGINT) * 60 + CAST(substr(said, 4, 2) AS BIGINT) END"
    return f"SELECT event_id, said, {parsed} AS minute_of_day, captured_at - captured_at % 86400 AS day_start FROM (SELECT event_id, captured_at, {said} AS said FROM (SELECT event_id, captured_at, {key} AS k FROM v_metrics) x) y"


def vector_parity(d: Dialect) -> str:
    """Each label's vectors pooled by their mean and normalised, and how far each vector of the label is from that: cosine and largest difference of a component."""
    parts = d.explode("(SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL)", "embedding", "x", "place")
    mean = f"SELECT label, place, avg(CAST(x AS DOUBLE)) AS m FROM {parts} GROUP BY label, place"
    pooled = f"SELECT label, place, m / n AS m FROM (SELECT label, place, m, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM ({mean}) a) b WHERE n > 0"
    return f"""SELECT vec_id, {d.real('sum(x * m) / sqrt(sum(x * x))')} AS cosine, {d.real('max(abs(x - m))')} AS max_abs_diff FROM (
        SELECT v.vec_id, CAST(v.x AS DOUBLE) AS x, p.m FROM (SELECT * FROM {parts}) v JOIN ({pooled}) p ON p.label = v.label AND p.place = v.place) j GROUP BY vec_id HAVING sum(x * x) > 0"""


def xml_escape(d: Dialect) -> str:
    """Escaped titles and folded names."""
    return f"SELECT item_id, {d.sha256(t.escape_xml(d, 'title'))} AS h, {d.sha256(t.normal_name(d, 'title'))} AS folded FROM v_items"


def json_props(d: Dialect) -> str:
    """A number out of a JSON document, and the document encoded again."""
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)" if d.spark else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    again = "to_json(map('k', get_json_object(props, '$.k')))" if d.spark else "'{\"k\":\"' || json_extract_string(props, '$.k') || '\"}'"
    return f"SELECT event_id, {k} AS k, {again} AS encoded FROM events"


def json_forms(d: Dialect) -> str:
    """Turns as JSON of lists, maps and structs with nulls, and what is read back of each."""
    if d.spark:
        made = "to_json(named_struct('words', split(text, ' '), 'meta', map('role', role, 'none', CAST(NULL AS STRING)), 'at', named_struct('turn', turn, 'none', CAST(NULL AS STRING))))"
        read = "from_json(js, 'words array<string>, meta map<string,string>, at struct<turn:bigint, none:string>')"
        return f"SELECT conv_id, turn, sha2(array_join(j.words, '|'), 256) AS words_hash, CAST(size(j.words) AS BIGINT) AS n_words, j.meta['role'] AS role, j.at.turn AS again, j.at.none IS NULL AND j.meta['none'] IS NULL AS none FROM (SELECT conv_id, turn, {read} AS j FROM (SELECT conv_id, turn, {made} AS js FROM conversations WHERE text IS NOT NULL) a) b"
    return "SELECT conv_id, turn, sha256(array_to_string(string_split(text, ' '), '|')) AS words_hash, len(string_split(text, ' ')) AS n_words, role, turn AS again, TRUE AS none FROM conversations WHERE text IS NOT NULL"


def cosine_similarity(d: Dialect) -> str:
    """Cosine, length and the score of a distance, of each vector against the first."""
    a, b = "a.embedding", "b.embedding"
    cos = f"{d.dot(a, b)} / (sqrt({d.dot(a, a)}) * sqrt({d.dot(b, b)}))"
    return f"SELECT a.vec_id, {d.real(cos)} AS cosine, {d.real(f'sqrt({d.dot(a, a)})')} AS length_l2, {d.real(f'greatest(-1.0, least(1.0, 1 - (1 - {cos})))', 5)} AS score FROM embeddings a JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b ON TRUE"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tokens_dedup, tokens_cluster, shingles, char_trigrams, char_bigrams, han_ngrams, sentence_summary, key_sentences,
        language_family, author_split, content_hash, stable_uuid, url_canonicalize, http_redaction, meta_extract, plain_text_simple,
        feed_autodiscovery, connector_routing, public_url_policy, retry_backoff, retention_cutoff, privacy_policy, fixed_times,
        xml_escape, json_props, cosine_similarity, json_forms, day_times, vector_parity,
    )
}
