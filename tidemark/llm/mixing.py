"""Mixing sources to target weights by hash-threshold histograms.

Each row has a 60-bit hash. Per source, words are summed by hash bucket; the running sum shows which buckets lie within the budget
as a whole and which single bucket holds the boundary; only that bucket is refined by the next 12 bits, and so on. What
comes out is one threshold a source, so the mix itself is a filter: no row is sorted, no group gathered.
Thresholds are nested: a larger budget keeps every row that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import driver_rows, free_name, n_words
from tidemark.plans.scratch import written

HASH_BITS, LEVEL_BITS = 60, 12
#: One row a source reaches the driver; sources are a registry, and a larger one is refused rather than cut.
MAX_SOURCES = 1_000_000


def row_hash(id_col: str, text_col: str) -> Column:
    """By id; by text where the id is null. md5 is the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))), 1, 15), 16, 10).cast("long")


def share(sizes: dict[str | None, int], weights: dict[str | None, int], cap: int) -> dict[str | None, float]:
    """Splits the sum of sizes by weight; a share stops at cap times its size, the excess is dealt again by weight."""
    open_, rest, out = {s for s, n in sizes.items() if n}, sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] * total < rest * weights[s]}
        if not full:
            return out | {s: rest * weights[s] / total for s in open_}
        out |= {s: float(cap * sizes[s]) for s in full}
        rest -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def repeating_weights(sources: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, int]:
    """Sources by code point, null last, weigh as the cycle repeats."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def thresholds(rows: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, int]:
    """By source, the hash below which rows are taken so that their words come nearest its budget.

    rows: source, size, h. Rows of one hash are taken together; the one at the boundary if over half of it fits.
    """
    spark, out = rows.sparkSession, {}
    state = {s: (0, b) for s, b in budgets.items()}
    shift = HASH_BITS - LEVEL_BITS
    while state:
        prefixes = driver_rows(spark, [(s, p, float(b)) for s, (p, b) in state.items()], "s string, prefix long, budget double")
        inside = rows.join(F.broadcast(prefixes), F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("s", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        sums = sums.withColumn("upto", upto)
        ends = sums.groupBy("s").agg(
            F.max(F.when(F.col("upto") <= F.col("budget"), F.col("bucket"))).alias("within"),
            F.min_by(F.struct("bucket", "lo", "hi", "n", (F.col("budget") - F.col("upto") + F.col("n")).alias("left")), F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("edge"),
        )
        now, state_next = {r["s"]: r for r in ends.collect()}, {}
        for s, (prefix, _) in state.items():
            row = now.get(s)
            edge = row and row["edge"]
            if not edge or edge["left"] <= 0:
                out[s] = (row["within"] + 1 if row and row["within"] is not None else prefix << LEVEL_BITS) << shift
            elif edge["lo"] == edge["hi"]:
                out[s] = edge["lo"] + (edge["n"] <= 2 * edge["left"])
            else:
                state_next[s] = (edge["bucket"], edge["left"])
        state, shift = state_next, shift - LEVEL_BITS
    return out


def mix(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """id, size, source_size, target, taken, copies (how often the mix takes the row).

    size is the number of words (null text: 0). Targets share 100 % of all words by weight, at most `cap` times a
    source's words. Every row is taken floor(target / source_size) times, and once more below its source's threshold,
    so that no row is taken over `cap` times. A null source is a source of its own; rows of size 0 take nothing; repeated
    rows of one id share a hash and are taken together; an empty table gives no rows. Needs no order and no
    randomness: reruns agree. With carry=True the result has all columns of docs and
    then `copies` (with underscores added to the name where docs has it).
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(id_col, text_col).alias("h"), F.col(id_col).alias("id")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("n"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sizes = {r["source"]: r["n"] for r in found}
    targets = share(sizes, repeating_weights(list(sizes), cycle), cap)
    whole = {s: int(targets[s] // n) if n else 0 for s, n in sizes.items()}
    cuts = thresholds(rows, {s: targets[s] - whole[s] * n for s, n in sizes.items() if n}) if sizes else {}
    plan = driver_rows(spark, [(s, n, targets[s], whole[s], cuts.get(s, 0)) for s, n in sizes.items()], "_s string, _n long, _target double, _whole long, _cut long")
    if carry:
        of, h, last = (free_name(x, docs.columns) for x in ("_of", "_hash", "copies"))
        plan = plan.toDF(*[free_name(c, docs.columns) for c in plan.columns])
        s, _, _, whole_, cut = (F.col(c) for c in plan.columns)
        own = docs.withColumns({h: row_hash(id_col, text_col), of: F.col(source_col)})
        copies = whole_ + F.when(F.col(h) < cut, 1).otherwise(0)
        return own.join(F.broadcast(plan), F.col(of).eqNullSafe(s)).select(*docs.columns, copies.alias(last))
    copies = F.col("_whole") + F.when(F.col("_h") < F.col("_cut"), 1).otherwise(0)
    own = rows.select(F.col("id").alias(id_col), F.col("size"), F.col("source").alias("_source"), F.col("h").alias("_h"))
    return own.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s"))).select(id_col, "size", F.col("_n").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * copies).alias("taken"), copies.alias("copies"))
