"""References to records that do not exist (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillstone.runtime import materialise


@dataclass(frozen=True)
class Target:
    """A table that is referred to: its key, when a row arrived and, if rows can be withdrawn, when it was deleted."""

    table: str
    rows: DataFrame
    key: str
    arrived: str
    deleted: str | None = None


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``field`` (a string or an array of strings) of ``rows`` refers to ``target``; ``own_key`` is what the rows' own
    children refer to, if any do."""

    table: str
    rows: DataFrame
    row_key: str
    field: str
    at: str
    target: str
    own_key: str | None = None
    when: str | None = None


def fold_key(c: Column) -> Column:
    """Keys compare without letter case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def lifetimes(target: Target) -> tuple[DataFrame, DataFrame]:
    """``(spans, gaps)`` of a target's keys.

    ``spans``: per key ``first`` arrival, ``forever`` (arrival of the first row that was never deleted) and ``last`` deletion.
    ``gaps``: the disjoint intervals ``[start, end)`` covered by rows that were deleted later. Copies collapse before anything is
    gathered by key; intervals are merged per key and day first, so that a hot key reaches a single task only as its merged islands.
    """
    deleted = F.col(target.deleted) if target.deleted else F.lit(None).cast("timestamp")
    rows = target.rows.select(fold_key(F.col(target.key)).alias("k"), F.col(target.arrived).alias("a"), deleted.alias("d")).filter("k IS NOT NULL AND a IS NOT NULL AND (d IS NULL OR d > a)")
    spans = rows.groupBy("k").agg(F.min("a").alias("first"), F.min(F.when(F.col("d").isNull(), F.col("a"))).alias("forever"), F.max("d").alias("last"))
    gone = rows.filter("d IS NOT NULL").distinct()
    for by in (["k", F.to_date("a")], ["k"]):
        w = W.partitionBy(*by).orderBy("a", "d")
        before = F.max("d").over(w.rowsBetween(W.unboundedPreceding, -1))
        marked = gone.withColumn("new", F.when(before.isNull() | (before < F.col("a")), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
        gone = marked.groupBy("k", *([F.to_date("a").alias("day")] if len(by) > 1 else []), "island").agg(F.min("a").alias("a"), F.max("d").alias("d")).select("k", "a", "d")
    return spans, gone


def dangling(ref: Reference, target: Target) -> DataFrame:
    """``src_table, src_key, src_field, ref_key, at, own_key`` of the references without a living target when they were written.

    Null references and array elements are none. Rows with a null time refer to nothing that lived. Equal references count once.
    """
    rows = ref.rows.filter(ref.when) if ref.when else ref.rows
    is_array = dict(rows.dtypes)[ref.field].startswith("array")
    refs = rows.select(
        F.col(ref.row_key).cast("string").alias("src_key"), F.col(ref.at).alias("at"), (F.col(ref.own_key) if ref.own_key else F.lit(None).cast("string")).alias("own_key"),
        (F.explode(F.array_distinct(ref.field)) if is_array else F.col(ref.field)).alias("ref_key"),
    ).filter("ref_key IS NOT NULL").withColumn("k", fold_key(F.col("ref_key")))
    spans, gone = lifetimes(target)
    dead = refs.join(spans, "k", "left").filter("forever IS NULL OR at IS NULL OR at < forever")
    if target.deleted:
        sure = F.coalesce(F.col("first").isNull() | F.col("at").isNull() | (F.col("at") < F.col("first")) | F.col("last").isNull() | (F.col("at") >= F.col("last")), F.lit(True))
        open_ = dead.withColumn("k", F.when(sure, F.lit(None)).otherwise(F.col("k"))).alias("r")
        dead = open_.join(gone.alias("g"), F.expr("r.k = g.k AND r.at >= g.a AND r.at < g.d"), "left_anti")
    return dead.select(F.lit(ref.table).alias("src_table"), "src_key", F.lit(ref.field).alias("src_field"), "ref_key", "at", "own_key").distinct()


def direct_orphans(references: list[Reference], targets: list[Target]) -> DataFrame:
    """The first step of the cascade, over all references."""
    by_table = {t.table: t for t in targets}
    out = None
    for ref in references:
        part = dangling(ref, by_table[ref.target])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("orphaned", F.lit("direct")).withColumn("round", F.lit(0))


def orphan_cascade(references: list[Reference], targets: list[Target]) -> DataFrame:
    """Direct orphans, and the references that inherit their fate: ``src_table, src_key, src_field, ref_key, at, orphaned, round``.

    A reference to a living record is orphaned indirectly if that record is itself an orphan. Each round semi-joins the references down
    the foreign-key graph with the keys first orphaned in the round before, until nothing is added (cycles end there, too). A record counts
    as orphaned from its first orphaned reference; its other references are still judged each on their own. Every round adds references or is
    the last, so the loop ends however deep the graph is.
    """
    one = ["src_table", "src_key", "src_field", "ref_key"]
    keys = lambda df: df.select("src_table", fold_key(F.col("own_key")).alias("k")).filter("k IS NOT NULL").distinct()
    found = materialise(direct_orphans(references, targets), "orphans")
    all_found, newly = [found], keys(found)
    seen, spread = found.select(*one).distinct(), newly
    for n in count(1):
        parts = []
        for ref in references:
            if not any(r.table == ref.target and r.own_key for r in references):
                continue
            parents = newly.filter(F.col("src_table") == ref.target).select("k")
            rows = ref.rows.filter(ref.when) if ref.when else ref.rows
            is_array = dict(rows.dtypes)[ref.field].startswith("array")
            refs = rows.select(
                F.lit(ref.table).alias("src_table"), F.col(ref.row_key).cast("string").alias("src_key"), F.lit(ref.field).alias("src_field"), F.col(ref.at).alias("at"),
                (F.col(ref.own_key) if ref.own_key else F.lit(None).cast("string")).alias("own_key"), (F.explode(F.array_distinct(ref.field)) if is_array else F.col(ref.field)).alias("ref_key"),
            )
            parts.append(refs.withColumn("k", fold_key(F.col("ref_key"))).join(parents, "k", "left_semi").drop("k").join(seen, one, "left_anti").distinct())
        if not parts:
            break
        step = parts[0]
        for p in parts[1:]:
            step = step.unionByName(p)
        fresh = materialise(step.select("src_table", "src_key", "src_field", "ref_key", "at", "own_key").withColumn("orphaned", F.lit("inherited")).withColumn("round", F.lit(n)), "inherited")
        if fresh.isEmpty():
            break
        all_found.append(fresh)
        seen = seen.unionByName(fresh.select(*one).distinct())
        newly = keys(fresh).join(spread, ["src_table", "k"], "left_anti")
        spread = spread.unionByName(newly)
    out = all_found[0]
    for part in all_found[1:]:
        out = out.unionByName(part)
    return out.drop("own_key")


def orphan_report(orphans: DataFrame, unit: str = "month") -> DataFrame:
    """``src_table, src_field, period, orphaned, n_refs, n_rows`` per table and period."""
    period = F.date_format(F.date_trunc(unit, "at"), "yyyy-MM-dd")
    return orphans.groupBy("src_table", "src_field", period.alias("period"), "orphaned").agg(F.count("*").alias("n_refs"), F.count_distinct("src_key").alias("n_rows"))
