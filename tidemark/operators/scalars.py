"""Small predicates, projections and logs that the larger operators build on, each over its whole table."""

from __future__ import annotations

from tidemark.functions import text as t
from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query

#: How many characters of a text go into a summary, a note, an embedding and a prompt.
PREFIXES = (360, 500, 4_000, 8_000)
#: Words that tell a language, with the least number of letters that a verdict needs and the characters that are read.
FUNCTION_WORDS = {"de": "der die und das mit sich des auf von den ist nicht", "en": "the of and to in is that for it as with was", "es": "el los las y que en un por con una para del", "fr": "le les et la un une des que dans est pour qui"}
LETTERS, READ_CHARS = 16, 8_000


def alias_qualifies(d: Dialect) -> str:
    """Aliases that may name an entity: a confidence of 0.8 or more and 2 to 100 characters."""
    return "SELECT event_id, item_id, source_id, alias, confidence >= 0.8 AND length(alias) BETWEEN 2 AND 100 AS qualifies FROM (SELECT m.event_id, m.item_id, m.source_id, m.confidence, trim(substr(t.name, 1, CAST(m.ordinal AS INT) % 4)) AS alias FROM v_memberships m JOIN v_topics t ON t.item_id = m.item_id) x"


def meaningful_domain(d: Dialect) -> str:
    """Hosts that mean something: not empty, not localhost, not under .local."""
    host = "lower(regexp_extract(u, " + d.re("^[a-zA-Z]+://([^/:?#]+)") + ", 1))"
    more = ", ".join(f"({-1 - i}, '{u}')" for i, u in enumerate(("http://localhost/", "http://printer.local/x", "https:///x", "mailto:a@b", "https://LOCALHOST:80", "https://local")))
    return f"SELECT page_id, host, host <> '' AND host <> 'localhost' AND host NOT LIKE '%.local' AS meaningful FROM (SELECT page_id, {host} AS host FROM (SELECT page_id, url AS u FROM v_pages UNION ALL SELECT page_id, u FROM (VALUES {more}) AS m(page_id, u)) y) x"


def http_only_url(d: Dialect) -> str:
    """A URL where its scheme is http or https, else null."""
    more = ", ".join(f"({-1 - i}, '{u}')" for i, u in enumerate(("ftp://a/b", "javascript:x", "HTTPS://E.org", " http://e.org", "")))
    return f"SELECT page_id, CASE WHEN {d.matches('u', '^(?i)https?://')} THEN u END AS url FROM (SELECT page_id, url AS u FROM v_pages UNION ALL SELECT page_id, u FROM (VALUES {more}) AS m(page_id, u)) x"


def membership_constraints(d: Dialect) -> str:
    """What a user's decisions leave behind: the latest of an item and event confirms or rejects the membership."""
    return """SELECT item_id, event_id, CASE decision WHEN 'accepted' THEN 'confirmedMembership' ELSE 'rejectedMembership' END AS kind FROM (
        SELECT item_id, event_id, decision, row_number() OVER (PARTITION BY item_id, event_id ORDER BY published_at DESC, ordinal DESC, source_id DESC) AS rn FROM v_memberships WHERE provenance = 'user' AND decision <> 'provisional') x WHERE rn = 1"""


def topic_assertions(d: Dialect) -> str:
    """Topics by normalized name, known or new, asserted for each event with a confidence of 0.8."""
    known = f"(SELECT normal, min(item_id) AS topic_id FROM (SELECT {t.normal_name(d, 'topic')} AS normal, item_id FROM v_topics WHERE size > 5) k GROUP BY normal)"
    return f"""SELECT DISTINCT m.event_id, n.normal AS topic, k.topic_id IS NULL AS created, CASE WHEN k.topic_id IS NULL THEN {t.name_uuid(d, 'n.normal')} ELSE CAST(k.topic_id AS {'STRING' if d.spark else 'VARCHAR'}) END AS topic_key, 0.8 AS confidence
        FROM v_memberships m JOIN (SELECT item_id, {t.normal_name(d, 'topic')} AS normal FROM v_topics) n ON n.item_id = m.item_id LEFT JOIN {known} k ON k.normal = n.normal WHERE m.decision = 'accepted'"""


def digest_state(d: Dialect) -> str:
    """A day's digest read back: its first revision, its latest one, how many there are and which additional times are done."""
    day, key = "CAST(floor(captured_at / 86400) AS BIGINT)", "captured_at * 10000000 + event_id"
    first, last = ("min_by", "max_by") if d.spark else ("arg_min", "arg_max")
    hour = "CAST(floor(captured_at % 86400 / 3600) AS BIGINT)"
    return f"SELECT {day} AS day_n, {first}(event_id, {key}) AS initial_id, {last}(event_id, {key}) AS latest_id, count(*) AS revisions, coalesce({d.join(d.gather(f'CASE WHEN {hour} IN (12, 18) THEN {hour} END'))}, '') AS done_hours FROM v_metrics WHERE metric = 'signup' GROUP BY {day}"


def key_points(d: Dialect) -> str:
    """The first three different excerpts of each text, in its order."""
    return f"""SELECT item_id, rn, excerpt FROM (SELECT item_id, excerpt, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rn FROM (
        SELECT item_id, excerpt, min(place) AS place FROM (SELECT item_id, place, substr(s, 1, 160) AS excerpt FROM {d.explode(f"(SELECT item_id, {t.sentences(d, 'plain_text')} AS ss FROM v_items)", "ss", "s", "place")}) y WHERE excerpt <> '' GROUP BY item_id, excerpt) z) x WHERE rn <= 3"""


def capped_postings(d: Dialect) -> str:
    """At most 600 postings of a short token: by item, as a cap without an order would take any."""
    return "SELECT topic, item_id FROM (SELECT topic, item_id, row_number() OVER (PARTITION BY topic ORDER BY item_id) AS rn FROM v_topics) x WHERE rn <= 600"


def text_prefixes(d: Dialect) -> str:
    """Line ends made one, blanks trimmed, and the prefixes that summaries, notes, embeddings and prompts take."""
    plain = f"trim({d.replace_all('plain_text', chr(92) + 'r' + chr(92) + 'n?', 'chr(10)')})"
    return f"SELECT item_id, {', '.join(d.sha256(f'substr(p, 1, {n})') + f' AS h_{n}' for n in PREFIXES)}, CAST(length(p) AS BIGINT) AS n FROM (SELECT item_id, {plain} AS p FROM (SELECT item_id, replace(plain_text, chr(10), concat(chr(13), chr(10))) AS plain_text FROM v_items) y) x"


def language_detect(d: Dialect) -> str:
    """Language by function words among the first 8,000 characters; none with under 16 letters or without a single such word."""
    words = d.split(f"lower(substr(plain_text, 1, {READ_CHARS}))", t.BREAKS)
    count = lambda own: d.size(d.filter("ws", "w", "w IN (" + ", ".join(f"'{x}'" for x in own.split()) + ")"))
    hits = ", ".join(f"{count(own)} AS n_{lang}" for lang, own in FUNCTION_WORDS.items())
    best = "greatest(" + ", ".join(f"n_{lang}" for lang in FUNCTION_WORDS) + ")"
    letters = d.size(d.find_all(f"substr(plain_text, 1, {READ_CHARS})", r"\p{L}"))
    return f"""SELECT item_id, CASE WHEN letters < {LETTERS} OR {best} = 0 THEN NULL {' '.join(f"WHEN n_{lang} = {best} THEN '{lang}'" for lang in FUNCTION_WORDS)} END AS detected, letters
        FROM (SELECT item_id, letters, {hits} FROM (SELECT item_id, {words} AS ws, {letters} AS letters FROM v_items) y) x"""


def prompt_template(d: Dialect) -> str:
    """Templates whose {{names}} are read from the text and filled from an item's values, with the names that have none: these stay as they are.

    A template is cut at its names; each piece is followed by the value of the name behind it, so that a value which itself looks like a name is left alone.
    """
    template = "CASE item_id % 3 WHEN 0 THEN 'Summarize {{title}} ({{language}}) for {{reader}}.' WHEN 1 THEN '{{source}}: {{title}} {{ title}} {{title}}' ELSE 'No names, {{{source}}} and {{}}.' END"
    pattern = "[{][{]([A-Za-z]+)[}][}]"
    names = d.map(d.find_all("template", pattern), "m", "substr(m, 3, length(m) - 4)")
    pieces = d.split("template", pattern)
    value = "CASE {0} WHEN 'title' THEN concat(substr(title, 1, 40), ' {{{{source}}}}') WHEN 'language' THEN coalesce(language_code, '') WHEN 'source' THEN source_id ELSE concat('{{{{', {0}, '}}}}') END"
    filled = f"concat({d.at('pieces', 'i')}, CASE WHEN i <= {d.size('names')} THEN {value.format(d.at('names', f'least(i, greatest({d.size(chr(110) + "ames")}, 1))'))} ELSE '' END)"
    count = d.size("pieces")
    all_ = d.map(f"sequence(1, CAST({count} AS INT))" if d.spark else f"range(1, {count} + 1)", "i", filled)
    missing = d.distinct(d.filter("names", "x", "x NOT IN ('title', 'language', 'source')"))
    return f"SELECT item_id, {d.join(all_, chr(39) * 2)} AS prompt, {d.join(missing)} AS missing FROM (SELECT *, {pieces} AS pieces, {'CASE WHEN size(' + names + ') = 0 THEN array(' + chr(39) * 2 + ') ELSE ' + names + ' END' if d.spark else names} AS names FROM (SELECT *, {template} AS template FROM v_items) x) y"


def vector_keys(d: Dialect) -> str:
    """Keys of vectors (the first 8 digest bytes as a little-endian unsigned number) and the namespace of their settings (12 bytes)."""
    h = d.sha256("concat(title, chr(10), substr(plain_text, 1, 4000))")
    flipped = " || ".join(f"substr(h, {2 * i - 1}, 2)" for i in range(8, 0, -1))
    number = f"conv({flipped}, 16, 10)" if d.spark else f"CAST(CAST('0x' || {flipped} AS UBIGINT) AS VARCHAR)"
    settings = "concat('{\"dims\":384,\"language\":\"', coalesce(language_code, ''), '\",\"model\":\"small\"}')"
    return f"SELECT item_id, {number} AS vector_key, substr({d.sha256(settings)}, 1, 24) AS namespace FROM (SELECT item_id, language_code, {h} AS h FROM v_items) x"


def header_lookup(d: Dialect) -> str:
    """The value of a header whatever the case of its name, and two header maps merged, the right one winning."""
    string = "STRING" if d.spark else "VARCHAR"
    asked = "CASE item_id % 3 WHEN 0 THEN 'ETAG' WHEN 1 THEN 'etag' ELSE 'VARY' END"
    date = f"CAST(published_at AS {string})"
    if d.spark:
        old, new = "map('ETag', content_hash, 'Vary', 'a')", f"map(CASE WHEN item_id % 2 = 0 THEN 'etag' ELSE 'Link' END, external_id, 'Date', {date})"
        low = lambda m: f"map_from_entries(transform(map_entries({m}), e -> struct(lower(e.key), e.value)))"
        merged = f"map_concat(map_filter({low(old)}, (k, v) -> NOT map_contains_key({low(new)}, k)), {low(new)})"
        shown = f"array_join(transform(array_sort(map_entries({merged})), e -> concat(e.key, '=', e.value)), ';')"
        return f"SELECT item_id, element_at({low(old)}, lower({asked})) AS found, {shown} AS merged FROM v_items"
    # here headers are lists of pairs, found by going through them
    old, new = "[{'k': 'ETag', 'v': content_hash}, {'k': 'Vary', 'v': 'a'}]", f"[{{'k': CASE WHEN item_id % 2 = 0 THEN 'etag' ELSE 'Link' END, 'v': external_id}}, {{'k': 'Date', 'v': {date}}}]"
    kept = f"list_filter({old}, lambda o: len(list_filter({new}, lambda n: lower(n.k) = lower(o.k))) = 0)"
    shown = f"array_to_string(list_sort(list_transform(list_concat({kept}, {new}), lambda e: concat(lower(e.k), '=', e.v))), ';')"
    return f"SELECT item_id, list_filter({old}, lambda o: lower(o.k) = lower({asked}))[1].v AS found, {shown} AS merged FROM v_items"


def remote_deletions(d: Dialect) -> str:
    """Items that their source reports as deleted: the state changes, the content stays."""
    return "SELECT i.item_id, CASE WHEN l.doc_id IS NULL THEN 'present' ELSE 'deleted' END AS remote_state, i.content_hash FROM v_items i LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = i.item_id"


def insert_select_literal(d: Dialect) -> str:
    """Rows copied from a table with a literal in place of a column, beside those that are there."""
    return "SELECT entity_id, kind, 'imported' AS origin FROM v_entities WHERE is_followed UNION ALL SELECT source_id, ecosystem, 'present' FROM v_sources"


def active_consent(d: Dialect) -> str:
    """The consent that covers each task of a provider, source and privacy class, or none: the latest that is granted, not revoked, and lists the task.

    A record revokes what its provider, source (none is one too) and privacy class had; a sign-up grants anew, with tasks, an error only revokes.
    """
    tasks = "CASE event_id % 4 WHEN 0 THEN " + d.array("'summarize'") + " WHEN 1 THEN " + d.array("'summarize'", "'translate'") + " WHEN 2 THEN " + d.array("'embed'") + " ELSE " + d.array("'embed'", "'translate'") + " END"
    own = "item_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 END AS source_id, CASE WHEN event_id % 5 < 3 THEN 'public' ELSE 'private' END AS privacy"
    last = lambda x: f"{'max_by' if d.spark else 'arg_max'}({x}, granted_at * 10000000 + event_id)"
    asked = " UNION ALL ".join(f"SELECT '{x}' AS task" for x in ("summarize", "translate", "embed"))
    granted = f"SELECT *, lead(granted_at) OVER (PARTITION BY item_id, source_id, privacy ORDER BY granted_at, event_id) AS revoked_at FROM (SELECT {own}, event_id, metric, captured_at AS granted_at, {tasks} AS tasks FROM v_metrics WHERE metric IN ('signup', 'error')) y"
    return f"""SELECT item_id AS provider_id, source_id, privacy, task, {last("CASE WHEN array_contains(tasks, task) AND metric = 'signup' AND revoked_at IS NULL THEN event_id END")} AS consent_id, count(revoked_at) AS revoked
        FROM ({granted}) x CROSS JOIN ({asked}) t GROUP BY item_id, source_id, privacy, task"""


def interaction_log(d: Dialect) -> str:
    """Follows and saves as logs: the latest of each kind holds, an odd number of presses being on; history keeps the last view."""
    return """SELECT item_id, sum(CASE WHEN metric = 'click' THEN 1 ELSE 0 END) % 2 = 1 AS followed, sum(CASE WHEN metric = 'signup' THEN 1 ELSE 0 END) % 2 = 1 AS saved,
        max(CASE WHEN metric = 'view' THEN captured_at END) AS last_viewed_at, count(*) AS interactions FROM v_metrics GROUP BY item_id"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        alias_qualifies, meaningful_domain, http_only_url, membership_constraints, topic_assertions, digest_state, key_points, capped_postings, text_prefixes,
        language_detect, prompt_template, vector_keys, header_lookup, remote_deletions, insert_select_literal, active_consent, interaction_log,
    )
}
