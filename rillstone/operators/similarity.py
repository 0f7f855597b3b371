"""Similarity joins and clusters over token sets."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillstone.runtime import materialise


def _rarest_first(items: DataFrame) -> DataFrame:
    """``item_id, token, pos, size``: each item's tokens, rarest first by document frequency."""
    rows = items.select("item_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    return rows.join(df, "token").withColumn("pos", F.row_number().over(W.partitionBy("item_id").orderBy("df", "token")))


def _candidates(prefix: DataFrame) -> DataFrame:
    """Distinct pairs that share a token of their prefixes."""
    a, b = prefix.select("token", F.col("item_id").alias("a")), prefix.select("token", F.col("item_id").alias("b"))
    return a.join(b, "token").filter("a < b").select("a", "b").distinct()


def _verify(pairs: DataFrame, items: DataFrame) -> DataFrame:
    ta, tb = items.select(F.col("item_id").alias("a"), F.col("tokens").alias("ta")), items.select(F.col("item_id").alias("b"), F.col("tokens").alias("tb"))
    full = pairs.join(ta, "a").join(tb, "b")
    return full.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), F.size("ta").alias("na"), F.size("tb").alias("nb"))


def jaccard_pairs(items: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, shared, na, nb`` (``a < b``) of items (``item_id, tokens``) with Jaccard similarity of at least num/den.

    Similar items share one of their ``n - ceil(n * num / den) + 1`` rarest tokens, which is all that is joined. Items without tokens have no
    pairs here, although they are alike one another.
    """
    ordered = _rarest_first(items)
    prefix = ordered.filter(F.expr(f"pos <= size - CAST((size * {num} + {den - 1}) DIV {den} AS INT) + 1"))
    return _verify(_candidates(prefix), items).filter(F.expr(f"shared * {den} >= {num} * (na + nb - shared)"))


#: So many of the most frequent tokens are bits in a row's words, a list of fixed size; the others are rare.
FREQUENT = 384
_WORDS = [f"w{i}" for i in range(FREQUENT // 64)]


def _coder(rank: dict[int, int]):
    """Of an item's hashes: its frequent tokens as bits and as sorted ranks, its rare ones as sorted hashes."""

    def code(hashes):
        words, common, rare = [0] * len(_WORDS), [], []
        for h in map(int, hashes):
            k = rank.get(h)
            if k is None:
                rare.append(h)
            else:
                common.append(k)
                words[k >> 6] |= 1 << (k & 63)
        return (*(w - (1 << 64) if w >> 63 else w for w in words), sorted(common), sorted(rare))

    return code


def _postings(items: DataFrame, num: int, den: int, floor: int) -> DataFrame:
    """``token, pos, size, need, n_rare, w0, ..., rare`` and the items' columns but ``tokens``: a row for each token at which an item can first meet another.

    Tokens are ordered alike everywhere: rare ones by hash (63 bits, negative), then the most frequent ones, by rank from the least frequent on.
    A pair that shares m tokens either has m frequent ones in common, then the first of them is among the first ``nf - m + 1`` of either item, or
    it shares at least ``g = m - min(nf, m - 1)`` rare ones, whose first is among the first ``nr - g + 1``. For m the smallest is taken that any
    partner may ask for.
    """
    hashes = F.transform("tokens", lambda t: F.xxhash64(t).bitwiseOR(F.lit(-(1 << 63))))
    rows = items.filter(F.size("tokens") >= max(1, floor)).withColumn("hashes", hashes)
    top = rows.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    least = rows.agg(F.min(F.size("tokens"))).head()[0] or 1  # one value
    kind = ", ".join([*(f"{w} bigint" for w in _WORDS), "common array<bigint>", "rare array<bigint>"])
    code = F.udf(_coder({r["h"]: k for k, r in enumerate(reversed(top))}), f"struct<{kind}>", useArrow=True)
    kept = [c for c in items.columns if c != "tokens"]
    coded = materialise(rows.select(*kept, F.size("tokens").alias("size"), code("hashes").alias("c")).select(*kept, "size", "c.*"), "coded")  # coded once, however often it is read
    coded = coded.withColumns({"n_rare": F.size("rare"), "n_common": F.size("common"), "m": _need(F.least("size", F.lit(least)), num, den, floor)})
    starts = F.expr("concat(slice(rare, 1, greatest(0, n_rare - (m - least(n_common, m - 1)) + 1)), slice(common, 1, greatest(0, n_common - m + 1)))")
    words = [F.coalesce(w, F.lit(0).cast("bigint")).alias(w) for w in _WORDS]  # never null, which makes comparing them shorter
    return coded.select(*kept, "size", _need(F.col("size"), num, den, floor).alias("need"), "n_rare", *words, "rare", F.posexplode(starts).alias("pos", "token"))


def _need(size: Column, num: int, den: int, floor: int) -> Column:
    """How many tokens a smaller set of this size must share."""
    return F.greatest(F.lit(max(1, floor)), ((size * num + den - 1) / den).cast("int"))


def _meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """Postings ``x`` and ``y``, columns with these prefixes, where two items share enough tokens; each pair is there once, at its first token.

    All that decides is at hand where postings meet, so neither candidates nor pairs are sent anywhere, sorted or made distinct. The conditions are
    kept short, since Java compiles no method of more than 8,000 bytes, and one that it doesn't compile takes a hundred times as long.
    """
    x, y = x.toDF(*[f"x_{c}" for c in x.columns]), y.toDF(*[f"y_{c}" for c in y.columns])
    need, out = F.least("x_need", "y_need"), [*x.columns, *y.columns]
    frequent = reduce(add, [F.bit_count(F.col(f"x_{w}").bitwiseAND(F.col(f"y_{w}"))) for w in _WORDS])
    left = F.least(F.col("x_n_rare") - F.col("x_pos"), F.col("y_n_rare") - F.col("y_pos"))
    rare = F.array_intersect("x_rare", "y_rare")
    by_rare = x.filter("x_token < 0").join(y.filter("y_token < 0"), (F.col("x_token") == F.col("y_token")) & (frequent < need) & (frequent + left >= need) & (frequent + F.size(rare) >= need) & (rare[0] == F.col("x_token")))
    below = [F.expr(f"CASE WHEN x_token >= {64 * (i + 1)} THEN x_{w} WHEN x_token > {64 * i} THEN x_{w} & ~shiftleft(-1L, CAST(x_token AS INT) - {64 * i}) ELSE 0L END").alias(f"below_{w}") for i, w in enumerate(_WORDS)]
    earlier = reduce(lambda p, q: p.bitwiseOR(q), [F.col(f"below_{w}").bitwiseAND(F.col(f"y_{w}")) for w in _WORDS])
    by_frequent = x.filter("x_token >= 0").select("*", *below).join(y.filter("y_token >= 0"), (F.col("x_token") == F.col("y_token")) & (frequent >= need) & (earlier == 0))
    return by_rare.select(*out).unionByName(by_frequent.select(*out))


def containment_pairs(items: DataFrame, num: int, den: int, floor: int) -> DataFrame:
    """``a, b, shared, na, nb`` (``a < b``) with at least ``floor`` shared tokens that are num/den of the smaller set."""
    posted = _postings(items.select("item_id", "tokens"), num, den, floor)
    met = _meet(posted, posted).filter("x_item_id < y_item_id")
    shared = reduce(add, [F.bit_count(F.col(f"x_{w}").bitwiseAND(F.col(f"y_{w}"))) for w in _WORDS]) + F.size(F.array_intersect("x_rare", "y_rare"))
    return met.select(F.col("x_item_id").alias("a"), F.col("y_item_id").alias("b"), shared.cast("int").alias("shared"), F.col("x_size").alias("na"), F.col("y_size").alias("nb"))


def overlap_pairs(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` across two item tables whose shared tokens are at least num/den of the smaller set; sets without tokens match nothing."""
    both = left.select("item_id", "tokens", F.lit(0).alias("s")).unionByName(right.select("item_id", "tokens", F.lit(1).alias("s")))
    posted = _postings(both, num, den, 1)
    met = _meet(posted.filter("s = 0").drop("s"), posted.filter("s = 1").drop("s"))
    return met.select(F.col("x_item_id").alias("a"), F.col("y_item_id").alias("b"))


def connected(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``item_id, cluster_id``: single-link clusters, named after their smallest member; the order of the items plays no part.

    Labels only get smaller, so the rounds end; the label of one's label shortens long chains, so they are few.
    """
    edges = materialise(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "edges")
    label = _settled(materialise(edges.select(F.col("x").alias("item_id")).distinct().withColumn("c", F.col("item_id")), "label"), edges)
    return items.select("item_id").join(label, "item_id", "left").select("item_id", F.coalesce("c", "item_id").alias("cluster_id"))


def _settled(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``item_id, c`` when no item hears a smaller label over its edges ``x, y`` or from the item its label names any more."""
    while True:
        heard = edges.join(label.toDF("y", "c"), "y").groupBy("x").agg(F.min("c").alias("low"))
        near = label.join(heard.toDF("item_id", "low"), "item_id", "left").select("item_id", "c", F.least("c", F.coalesce("low", "c")).alias("n"))
        jumped = near.join(near.select(F.col("item_id").alias("n"), F.col("n").alias("far")), "n", "left").select("item_id", "c", F.least("n", F.coalesce("far", "n")).alias("n"))
        step = materialise(jumped, "label")
        label = step.select("item_id", F.col("n").alias("c"))
        if step.filter("n <> c").isEmpty():
            return label


def greedy(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``item_id, cluster_id``: first-fit clusters in the order of ``item_id``, each item joining the earliest cluster it is linked to.

    An item's cluster is the smallest among its own number and the clusters of earlier items it is similar to; the labels travel from
    earlier to later items only until they settle. What the item of one's label has heard comes from earlier items, too.
    """
    back = materialise(pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    label = materialise(items.select("item_id", F.col("item_id").alias("c")), "label")
    return _settled(label, back).select("item_id", F.col("c").alias("cluster_id"))


def link_empty(items: DataFrame) -> DataFrame:
    """Pairs that link all items without tokens, which count as alike: each with the first."""
    empty = items.filter(F.size("tokens") == 0).select("item_id")
    first = empty.agg(F.min("item_id")).head()[0]  # one value
    return empty.filter(F.col("item_id") > F.lit(first)).select(F.lit(first).cast(empty.dtypes[0][1]).alias("a"), F.col("item_id").alias("b"))


def signatures(members: DataFrame) -> DataFrame:
    """``cluster_id, signature``: tokens of at least half the members, else the shortest normalised text; from ``cluster_id, item_id, normalized, tokens``."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(F.struct(F.length("normalized").alias("l"), "normalized")).alias("s"))
    held = members.select("cluster_id", F.explode("tokens").alias("t")).groupBy("cluster_id", "t").agg(F.count("*").alias("k"))
    common = held.join(size, "cluster_id").filter("k >= greatest(1, (n + 1) DIV 2)").groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("common"))
    return size.join(common, "cluster_id", "left").select("cluster_id", F.coalesce("common", "s.normalized").alias("signature"))


def cluster_report(members: DataFrame, least: int) -> DataFrame:
    """``cluster_id, size, sessions, score, signature`` of clusters with at least ``least`` members; score is size times mean token count."""
    stats = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("session_id").alias("sessions"), F.sum(F.size("tokens")).cast("double").alias("score")).filter(F.col("size") >= least)
    return stats.join(signatures(members), "cluster_id")
