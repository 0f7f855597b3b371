"""Mixing sources to target weights by a low-discrepancy schedule (problem 9)."""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillstone.llm.tokens import TOKENIZER_DIR, token_counts
from rillstone.runtime import materialise

#: Tokens of a schedule slot, and rows within which a running sum is taken by one task.
BLOCK_TOKENS, CHUNK = 512, 50_000

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
_STRIDE = 1 << 26


def golden_point(n: Column) -> Column:
    """The n-th point of the golden-ratio sequence in [0, 1), computed in two digits so that large n keep their precision."""
    high, low = F.floor(n / _STRIDE), n % _STRIDE
    x = high.cast("double") * float(_STRIDE * _GOLDEN % 1) + low.cast("double") * float(_GOLDEN)
    return x - F.floor(x)


def running_start(rows: DataFrame, by: list[str], order: str, tie: str, amount: str, buckets: Column) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over the rows of the same ``by`` before this one in the order of the 64-bit hash ``order``, then ``tie``.

    The hash's range is cut into ``buckets`` equal parts; sums of the parts are accumulated first, so no task sorts a whole group.
    """
    part = F.floor((F.shiftright(order, 1).cast("double") / 2.0**63 + 0.5) * buckets).cast("bigint")
    rows = rows.withColumn("__part", part)
    sums = rows.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*by, "__part").orderBy(order, tie).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return placed.join(before, [*by, "__part"]).withColumn("start", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def _slots(live: DataFrame, sources: int, slots_n: int) -> DataFrame:
    """``slot, source``: each slot's point, looked up in the table of cumulative weights.

    Weights are whole numbers, so the sources' ranges meet exactly. The table is cut into about four cells per source; a point is joined with the
    few ranges of its cell by equality, however many sources there are.
    """
    ranges = running_start(live.withColumns({"one": F.lit(1), "h": F.xxhash64("source")}), ["one"], "h", "source", "weight", F.lit(float(-(-sources // CHUNK))))
    ranges = ranges.select("source", F.col("start").alias("low"), (F.col("start") + F.col("weight")).alias("high"))
    total = live.agg(F.sum("weight")).head()[0]  # one number
    width = max(1, total // (4 * sources))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"low DIV {width}"), F.expr(f"(high - 1) DIV {width}"))))
    point = F.least(F.floor(golden_point(F.col("slot") + 1) * F.lit(float(total))).cast("bigint"), F.lit(total - 1))
    slots = live.sparkSession.range(slots_n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.expr(f"point DIV {width}"))
    return slots.join(cells, "cell").filter("point >= low AND point < high").select("slot", "source")


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZER_DIR, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """``slot, source, doc_id, use_no, n_tokens``: the drawn documents in the order of the schedule.

    The mix is the largest one whose shares can follow the targets (scaled to 1 over the sources that have text) when no text is used more
    than its source's ``max_repeats``. Equal texts count as one text, of the row with the smallest id. Slots of ``block_tokens`` tokens get
    their source from the golden-ratio sequence; the r-th slot of a source takes the texts that start in its r-th block of the shuffled
    source. Null and empty texts, sources not listed, and targets that are null or not above 0 take no part; null ``max_repeats`` counts as 1; of
    several targets of a source the largest counts. Sources may be any number.
    """
    spark = docs.sparkSession
    repeats = F.coalesce("max_repeats", F.lit(1))
    listed = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", repeats.alias("repeats"))).alias("t"))
    listed = listed.select("source", F.col("t.target_share").alias("share"), F.col("t.repeats").alias("repeats")).filter("repeats > 0")
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).filter(F.col("text") != "")
    chosen = chosen.join(targets.filter("source IS NOT NULL AND target_share > 0").select("source").distinct(), "source", "left_semi").withColumn("digest", F.unhex(F.md5("text")))
    counted = token_counts(chosen, ["doc_id", "source", "digest"], "text", folder)
    texts = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.doc_id", "d.source", "d.n_tokens").filter("n_tokens > 0")
    texts = materialise(texts, "texts")
    totals = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    live = materialise(totals.join(listed, "source"), "sources")
    whole = live.agg(F.sum("share").alias("w"), F.count("*").alias("n"), F.min(F.col("tokens") * F.col("repeats") / F.col("share")).alias("b")).head()  # one row
    schema = "slot bigint, source string, doc_id bigint, use_no int, n_tokens bigint"
    if not whole["n"]:
        return spark.createDataFrame([], schema)
    slots_n = max(1, int(whole["b"] * whole["w"] / block_tokens))
    share = F.col("share") / F.lit(whole["w"])
    live = live.withColumn("weight", F.greatest(F.lit(1), F.round(share * 2.0**50)).cast("bigint"))

    # the schedule: a source for each slot, and the slot's rank among those of its source
    slots = _slots(live, whole["n"], slots_n).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    per_chunk = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = per_chunk.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = slots.withColumn("r", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1).join(before, ["source", "chunk"])
    ranked = ranked.select("source", "slot", (F.col("before") + F.col("r")).alias("block"))

    # the texts of each source, shuffled anew for each use, cut into blocks
    uses = F.least(F.col("repeats"), F.floor(share * slots_n * block_tokens / F.col("tokens")) + 2).cast("int")
    each = live.select("source", "tokens", uses.alias("uses"), F.ceil(F.col("texts") / CHUNK).cast("double").alias("parts"))
    repeated = texts.join(each, "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    shuffled = repeated.withColumn("h", F.xxhash64("doc_id", "use_no", F.lit(seed)))
    placed = running_start(shuffled, ["source", "use_no"], "h", "doc_id", "n_tokens", F.col("parts"))
    begin = F.col("start") + (F.col("use_no") - 1) * F.col("tokens")
    blocks = placed.withColumn("block", F.floor(begin / block_tokens).cast("bigint"))
    return blocks.join(ranked, ["source", "block"]).select("slot", "source", "doc_id", "use_no", "n_tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_texts, most_uses`` per listed source."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("uses"))
    sums = per_doc.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count("*").alias("n_texts"), F.max("uses").alias("most_uses"))
    whole = F.sum("n_tokens").over(W.partitionBy())  # one row per source
    out = targets.select("source", "target_share").join(sums, "source", "left").fillna(0, ["n_tokens", "n_texts", "most_uses"])
    return out.withColumn("actual_share", F.col("n_tokens") / F.when(whole > 0, whole))
