"""Filling containers of fixed capacity by minimum bin slack (problem 8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillstone.llm.tokens import TOKENIZER_DIR, token_counts
from rillstone.runtime import materialise

#: Items a task packs on its own; each such block leaves a few containers with room at most.
BLOCK_ITEMS = 20_000


def fullest(capacity: int, available: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``(length, how many)`` of the combination with the largest sum up to ``capacity``, from ``(length, count)`` in falling order of length.

    Subset sums are the bits of an integer. Counts are split into powers of two; the search ends as soon as the capacity itself is reached.
    """
    mask, sums, steps = (1 << (capacity + 1)) - 1, 1, []
    for length, count in available:
        if length > capacity:
            continue
        left, k = min(count, capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            k *= 2
            if sums >> capacity:
                break
        if sums >> capacity:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return list(chosen.items())


def pack(lengths: list[int], capacity: int) -> list[int]:
    """Container number of each item (no longer than the capacity): each container takes the longest item left and then the fullest
    combination of the others. Items of length 0 go into the first container."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    empty = by_length.pop(0, [])
    order = sorted(by_length, reverse=True)
    out, bin_no = [0] * len(lengths), 0
    while order:
        first = order[0]
        picked = [(first, 1)]
        by_length_first = by_length[first]
        room = capacity - first
        if room:
            available = [(n, len(by_length[n]) - (n == first)) for n in order if n <= room]
            picked += fullest(room, [a for a in available if a[1] > 0])
        for n, k in picked:
            items = by_length[n]
            for _ in range(k):
                out[items.pop()] = bin_no
        if not by_length_first or any(not by_length[n] for n, _ in picked):
            order = [n for n in order if by_length[n]]
        bin_no += 1
    for i in empty:
        out[i] = 0
    return out


def pack_documents(docs: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``capacity_name, container, doc_id, piece, start_token, end_token, n_tokens``: every text in containers of each capacity.

    Only texts above a capacity are split, at multiples of the capacity. Items are dealt by hash into blocks of about ``block_items``, each
    packed by one task; there are as many blocks as the pieces of a capacity need. Containers of a capacity are numbered block by block, from
    the numbers that the blocks filled. Null texts come out with a null container and count, empty ones as items of length 0; capacities that are null or
    below 1 are left out; repeated rows are items of their own.
    """
    counted = materialise(token_counts(docs.withColumnRenamed(doc_id, "__id"), ["__id"], text, folder).withColumnRenamed("__id", "doc_id"), "counted")
    sizes = capacities.filter("capacity_tokens >= 1").select("capacity_name", "capacity_tokens").distinct()
    each = _with_sizes(counted, sizes)
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens"))).cast("int")))
    items = each.filter("n_tokens IS NOT NULL").select("capacity_name", "capacity_tokens", "doc_id", "n_tokens", piece.alias("piece"))
    start = F.col("piece") * F.col("capacity_tokens")
    items = items.withColumn("start_token", start).withColumn("end_token", F.least(start + F.col("capacity_tokens"), "n_tokens")).withColumn("n_tokens", F.col("end_token") - F.col("start_token"))
    # one row per capacity; names may be null, and one name may have several capacities
    pieces = each.groupBy("capacity_name", "capacity_tokens").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))).alias("n")).filter("n IS NOT NULL").collect()
    blocks = F.when(F.lit(False), F.lit(1))
    for r in pieces:
        mine = F.col("capacity_name").eqNullSafe(F.lit(r["capacity_name"])) & (F.col("capacity_tokens") == r["capacity_tokens"])
        blocks = blocks.when(mine, F.lit(-(-int(r["n"]) // block_items)))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "capacity_name"), blocks))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece"], kind="stable")
        numbers = pack(group["n_tokens"].tolist(), int(group["capacity_tokens"].iloc[0]))
        return group.assign(container=pd.Series(numbers, index=group.index))[["block", "capacity_tokens", *names]]

    names = ["capacity_name", "container", "doc_id", "piece", "start_token", "end_token", "n_tokens"]
    kind = dict(counted.dtypes)["doc_id"]
    schema = f"capacity_name string, container bigint, doc_id {kind}, piece int, start_token bigint, end_token bigint, n_tokens bigint"
    filled = materialise(items.groupBy("capacity_name", "capacity_tokens", "block").applyInPandas(fill, f"block bigint, capacity_tokens bigint, {schema}"), "filled")
    used = filled.groupBy("capacity_name", "capacity_tokens", "block").agg((F.max("container") + 1).alias("n"))
    before = W.partitionBy("capacity_name").orderBy("capacity_tokens", "block").rowsBetween(W.unboundedPreceding, -1)
    used = used.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))  # one row per block
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ("capacity_name", "capacity_tokens", "block")]
    packed = filled.alias("f").join(used.alias("u"), same).select("f.capacity_name", (F.col("f.container") + F.col("u.first")).alias("container"), *[f"f.{n}" for n in names[2:]])
    none = each.filter("n_tokens IS NULL").select("capacity_name", F.lit(None).cast("bigint").alias("container"), "doc_id", F.lit(0).alias("piece"), *[F.lit(None).cast("bigint").alias(n) for n in names[4:]])
    return packed.unionByName(none)


def _with_sizes(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each row once per capacity; the few capacities are collected and exploded from a literal."""
    few = sizes.limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("more than 1000 capacities")
    if not few:
        return counted.withColumn("capacity_name", F.lit(None).cast("string")).withColumn("capacity_tokens", F.lit(None).cast("bigint")).limit(0)
    array = F.array(*[F.struct(F.lit(r[0]).alias("name"), F.lit(r[1]).cast("bigint").alias("tokens")) for r in sorted(few, key=lambda r: (str(r[0]), r[1]))])
    return counted.withColumn("__c", F.explode(array)).select("*", F.col("__c.name").alias("capacity_name"), F.col("__c.tokens").alias("capacity_tokens")).drop("__c")


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``capacity_name, n_containers, n_items, n_tokens, fill``: how full the containers of each capacity are."""
    sums = packed.filter("container IS NOT NULL").groupBy("capacity_name").agg(F.count_distinct("container").alias("n_containers"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    out = sums.join(capacities.select("capacity_name", "capacity_tokens").distinct(), "capacity_name")
    return out.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).drop("capacity_tokens")
