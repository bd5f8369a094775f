"""One text for a query, in Spark SQL or in DuckDB's SQL."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """Spells what the two engines spell differently. Arguments and results are SQL text."""

    spark: bool

    def re(self, pattern: str) -> str:
        """A string literal with a regular expression."""
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def text(self, value: str) -> str:
        return "'" + (value.replace("\\", "\\\\").replace("\n", "\\n") if self.spark else value).replace("'", "\\'" if self.spark else "''") + "'"

    @property
    def newline(self) -> str:
        return "chr(10)"

    def starts(self, x: str, head: str) -> str:
        return f"startswith({x}, {head})" if self.spark else f"starts_with({x}, {head})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def n_bytes(self, x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)" if self.spark else f"CAST(strlen({x}) AS BIGINT)"

    def seconds(self, ts: str) -> str:
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def map(self, xs: str, name: str, body: str) -> str:
        return f"transform({xs}, {name} -> {body})" if self.spark else f"list_transform({xs}, lambda {name}: {body})"

    def filter(self, xs: str, name: str, body: str) -> str:
        return f"filter({xs}, {name} -> {body})" if self.spark else f"list_filter({xs}, lambda {name}: {body})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.re(pattern)})" if self.spark else f"string_split_regex({x}, {self.re(pattern)})"

    def find_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, 0)" if self.spark else f"regexp_extract_all({x}, {self.re(pattern)})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, {by})" if self.spark else f"regexp_replace({x}, {self.re(pattern)}, {by}, 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.re(pattern)})" if self.spark else f"regexp_matches({x}, {self.re(pattern)})"

    def distinct(self, xs: str) -> str:
        """Distinct elements in ascending order."""
        return f"array_sort(array_distinct({xs}))" if self.spark else f"list_sort(list_distinct({xs}))"

    def sort(self, xs: str) -> str:
        return f"array_sort({xs})" if self.spark else f"list_sort({xs})"

    def concat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})" if self.spark else f"list_concat({', '.join(xs)})"

    def join(self, xs: str, by: str = "','") -> str:
        return f"array_join({xs}, {by})" if self.spark else f"array_to_string({xs}, {by})"

    def size(self, xs: str) -> str:
        return f"CAST(size({xs}) AS BIGINT)" if self.spark else f"CAST(len({xs}) AS BIGINT)"

    def common(self, a: str, b: str) -> str:
        return self.size(f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})")

    def gather(self, x: str) -> str:
        """Aggregate: distinct values in ascending order."""
        return f"array_sort(collect_set({x}))" if self.spark else f"list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL))"

    def gather_all(self, x: str) -> str:
        return f"array_sort(collect_list({x}))" if self.spark else f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"

    def n_distinct(self, x: str) -> str:
        """Aggregate: number of distinct values, for sets that stay small; without the copies of rows that several count(DISTINCT ...) make."""
        return f"CAST(size(collect_set({x})) AS BIGINT)" if self.spark else f"count(DISTINCT {x})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def windows(self, xs: str, n: int, body: str) -> str:
        """body for each i, the 1-based start of a run of n elements of xs; xs has n elements at least."""
        top = f"size({xs}) - {n - 1}" if self.spark else f"len({xs}) - {n - 1}"
        return self.map(f"sequence(1, {top})" if self.spark else f"range(1, {top} + 1)", "i", body)

    def at(self, xs: str, i: str) -> str:
        """Element at the 1-based place."""
        return f"element_at({xs}, CAST({i} AS INT))" if self.spark else f"list_extract({xs}, CAST({i} AS BIGINT))"

    def explode(self, table: str, xs: str, name: str, place: str | None = None) -> str:
        """A FROM clause: a row of table for each element, with its place from 0."""
        if self.spark:
            return f"{table} LATERAL VIEW posexplode({xs}) AS {place or '_at'}, {name}"
        return f"(SELECT *, unnest({xs}) AS {name}, generate_subscripts({xs}, 1) - 1 AS {place or '_at'} FROM {table})"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def any_true(self, x: str) -> str:
        return f"bool_or({x})"

    def real(self, x: str, digits: int = 6) -> str:
        return f"round(CAST({x} AS DOUBLE), {digits})"

    def now(self, text: str) -> str:
        """A fixed moment in seconds."""
        return self.seconds(f"TIMESTAMP '{text}'")


SPARK, DUCK = Dialect(True), Dialect(False)
