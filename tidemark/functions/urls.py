"""URL functions, as column expressions and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of query parameters that only track a visit; names that start with utm_ do too.
TRACKING = [
    "fbclid", "gclid", "dclid", "mc_cid", "mc_eid", "igshid", "ref_src", "spm",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no fragment, default port or tracking parameter, parameters sorted, one final slash less.

    A string without scheme:// stays as it is.
    """
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    scheme, authority = F.lower(part(_SCHEME)), part(_AUTHORITY)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    port = F.regexp_extract(place, r":([0-9]+)$", 1)
    standard = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    host = F.lower(F.regexp_replace(place, r":[0-9]*$", ""))
    path = part(_PATH)
    short = F.when((F.length(path) > 1) & path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    name = lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1)))
    kept = F.filter(F.split(part(_QUERY), "&"), lambda x: (x != "") & ~name(x).isin(TRACKING) & ~name(x).startswith("utm_"))
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("n"), F.regexp_replace(x, "^[^=]*=?", "").alias("v"), x.alias("x"))))
    query = F.array_join(F.transform(keyed, lambda s: s["x"]), "&")
    made = F.concat(scheme, F.lit("://"), user, host, F.when((port != "") & ~standard, F.concat(F.lit(":"), port)).otherwise(""), short, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme == "", url).otherwise(made)


def canonical_url_sql(url: str) -> str:
    """The same in DuckDB."""
    names = ", ".join(f"'{x}'" for x in TRACKING)
    scheme = f"lower(regexp_extract({url}, '{_SCHEME}', 1))"
    authority = f"regexp_extract({url}, '{_AUTHORITY}', 1)"
    place = f"regexp_replace({authority}, '^.*@', '')"
    port = f"regexp_extract({place}, ':([0-9]+)$', 1)"
    path = f"regexp_extract({url}, '{_PATH}', 1)"
    kept = f"list_filter(string_split(regexp_extract({url}, '{_QUERY}', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({names}) AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_'))"
    keyed = f"list_sort(list_transform({kept}, lambda x: {{'n': split_part(x, '=', 1), 'v': regexp_replace(x, '^[^=]*=?', ''), 'x': x}}))"
    query = f"array_to_string(list_transform({keyed}, lambda s: s.x), '&')"
    return (
        f"CASE WHEN {scheme} = '' THEN {url} ELSE {scheme} || '://' || regexp_extract({authority}, '^(.*@)', 1) || lower(regexp_replace({place}, ':[0-9]*$', ''))"
        f" || CASE WHEN {port} <> '' AND NOT (({scheme} = 'https' AND {port} = '443') OR ({scheme} = 'http' AND {port} = '80')) THEN ':' || {port} ELSE '' END"
        f" || CASE WHEN length({path}) > 1 AND ends_with({path}, '/') THEN left({path}, -1) ELSE {path} END"
        f" || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )


def canonical_url_spark_sql(url: str) -> str:
    """The same in Spark SQL."""
    names = ", ".join(f"'{x}'" for x in TRACKING)
    get = lambda pattern, x=url: f"regexp_extract({x}, r'{pattern}', 1)"
    scheme, authority = f"lower({get(_SCHEME)})", get(_AUTHORITY)
    place = f"regexp_replace({authority}, '^.*@', '')"
    port, path = get(":([0-9]+)$", place), get(_PATH)
    kept = f"filter(split({get(_QUERY)}, '&'), x -> x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({names}) AND NOT startswith(lower(split_part(x, '=', 1)), 'utm_'))"
    keyed = f"array_sort(transform({kept}, x -> struct(split_part(x, '=', 1) AS n, regexp_replace(x, '^[^=]*=?', '') AS v, x AS x)))"
    query = f"array_join(transform({keyed}, s -> s.x), '&')"
    return (
        f"CASE WHEN {scheme} = '' THEN {url} ELSE {scheme} || '://' || {get('^(.*@)', authority)} || lower(regexp_replace({place}, ':[0-9]*$', ''))"
        f" || CASE WHEN {port} <> '' AND NOT (({scheme} = 'https' AND {port} = '443') OR ({scheme} = 'http' AND {port} = '80')) THEN ':' || {port} ELSE '' END"
        f" || CASE WHEN length({path}) > 1 AND endswith({path}, '/') THEN left({path}, length({path}) - 1) ELSE {path} END"
        f" || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )
