import itertools
import random

from rillstone.llm import packing as P
from rillstone.llm.tokens import encoding


def test_fullest_is_optimal():
    r = random.Random(1)
    for _ in range(300):
        cap = r.randint(1, 40)
        items = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= cap)
        counts = [(n, items.count(n)) for n in sorted(set(items), reverse=True)]
        got = P.fullest(cap, counts)
        assert sum(n * k for n, k in got) == best and all(0 < k <= items.count(n) for n, k in got)


def test_pack_holds_everything_once():
    r = random.Random(2)
    for cap in (1, 7, 100):
        lengths = [r.randint(0, cap) for _ in range(400)] + [cap] * 3
        bins = P.pack(lengths, cap)
        fill: dict[int, int] = {}
        for n, b in zip(lengths, bins):
            fill[b] = fill.get(b, 0) + n
        assert max(fill.values()) <= cap and len(fill) <= sum(lengths) / cap * 1.05 + 2
    assert P.pack([], 5) == [] and P.pack([0, 0], 5) == [0, 0]


def test_documents(spark):
    texts = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 1000), (5, "one two three"), (5, "one two three"), (6, "﻿ <|endoftext|> é")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "'x' as capacity_name")
    sizes = spark.createDataFrame([("a", 64), ("b", 2048), ("b", 2048), ("bad", None), ("zero", 0)], "capacity_name string, capacity_tokens bigint")
    out = P.pack_documents(docs, sizes, block_items=3).toPandas()
    assert set(out["capacity_name"]) == {"a", "b"} and len(out[out["container"].isna()]) == 2
    n = {d: len(encoding().encode_ordinary(t)) for d, t in texts if t is not None}
    for name, cap in (("a", 64), ("b", 2048)):
        mine = out[(out["capacity_name"] == name) & out["container"].notna()]
        assert mine.groupby("container")["n_tokens"].sum().max() <= cap
        assert mine[mine["doc_id"] == 4]["n_tokens"].sum() == n[4] and len(mine[mine["doc_id"] == 4]) == -(-n[4] // cap)
        assert len(mine[mine["doc_id"] == 5]) == 2 and len(mine[mine["doc_id"] == 3]) == 1
        assert (mine[mine["doc_id"].isin([1, 5, 6])]["piece"] == 0).all()
    assert P.pack_documents(docs.limit(0), sizes).count() == 0 and P.pack_documents(docs, sizes.limit(0)).count() == 0
    report = {r["capacity_name"]: r for r in P.fill_report(P.pack_documents(docs, sizes), sizes).collect()}
    assert report["b"]["n_containers"] == 1 and 0 < report["b"]["fill"] <= 1


def test_blocks_do_not_share_containers(spark):
    """Texts of many pieces each, in several blocks: no container above its capacity, blocks near their size."""
    docs = spark.createDataFrame([(i, "word " * 400) for i in range(12)], "doc_id bigint, text string")
    sizes = spark.createDataFrame([("a", 7), ("b", 50), ("b", 60)], "capacity_name string, capacity_tokens bigint")
    out = P.pack_documents(docs, sizes, block_items=4).toPandas()
    for name, cap in (("a", 7), ("b", 60)):
        mine = out[out["capacity_name"] == name]
        fill = mine.groupby("container")["n_tokens"].sum()
        assert fill.max() <= cap and sorted(fill.index) == list(range(len(fill)))
    pieces = out[out["capacity_name"] == "a"]
    assert pieces["n_tokens"].sum() == 12 * len(encoding().encode_ordinary("word " * 400)) and not pieces.duplicated(["doc_id", "piece"]).any()
