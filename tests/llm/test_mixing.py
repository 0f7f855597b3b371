import random

from pyspark.sql import functions as F

from rillstone.llm import mixing as M


def docs(spark, n=900, seed=1):
    r = random.Random(seed)
    sources = ["big"] * 6 + ["mid"] * 2 + ["small"]
    data = [(i, " ".join(r.choices("alpha beta gamma delta epsilon zeta eta".split(), k=r.randint(1, 60))) + f" {i}", r.choice(sources), "x") for i in range(n)]
    data += [(n + i, data[i][1], "big", "x") for i in range(30)] + [(-1, None, "big", "x"), (-2, "", "mid", "x"), (-3, "other", "unlisted", "x"), (-4, "none", None, "x")]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, slot string")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.4, 2), ("off", 0.0, 1)], "source string, target_share double, max_repeats bigint")
    d = docs(spark)
    out = M.mix(d, targets, block_tokens=64)
    report = {r["source"]: r for r in M.share_report(out, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(report[s]["actual_share"] - share) < 0.03
    assert report["absent"]["n_tokens"] == 0
    uses = out.join(d.select("doc_id", F.md5("text").alias("t")), "doc_id").groupBy("source", "t").count()
    most = {r[0]: r[1] for r in uses.groupBy("source").agg(F.max("count")).collect()}
    assert most["big"] == 1 and most["mid"] <= 2 and most["small"] <= 3
    assert out.filter("doc_id < 0").count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, M.mix(d.repartition(3), targets, block_tokens=64).collect()))


def test_degenerate(spark):
    targets = spark.createDataFrame([("big", 1.0, None), (None, 0.5, 1)], "source string, target_share double, max_repeats bigint")
    one = spark.createDataFrame([(1, "only text", "big")], "doc_id bigint, text string, source string")
    assert [(r["doc_id"], r["use_no"]) for r in M.mix(one, targets).collect()] == [(1, 1)]
    assert M.mix(one.limit(0), targets).count() == 0 and M.mix(one, targets.limit(0)).count() == 0


def test_golden_points_are_spread(spark):
    n = 4000
    for start in (0, 10**12):
        x = sorted(r[0] for r in spark.range(start, start + n).select(M.golden_point(F.col("id"))).collect())
        gaps = [b - a for a, b in zip(x, x[1:])]
        assert 0 <= x[0] and x[-1] < 1 and max(gaps) < 3 / n and min(gaps) > 0.2 / n


def test_running_start(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7).alias("n"), F.xxhash64("id").alias("h"))
    got = M.running_start(d, ["source"], "h", "doc_id", "n", F.lit(8.0)).orderBy("h").collect()
    total = 0
    for r in got:
        assert r["start"] == total
        total += r["n"]


def test_three_thousand_sources(spark):
    n = 3000
    targets = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), (1.0 + F.col("id") % 5).alias("target_share"), F.lit(2).cast("bigint").alias("max_repeats"))
    d = spark.range(n * 3).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text number"), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % n).alias("source"))
    out = M.mix(d, targets, block_tokens=1)
    assert out.select("source").distinct().count() == n
    total = out.agg(F.sum("n_tokens")).head()[0]
    # a source of few tokens is off by less than two of its texts, which have about eight tokens
    assert M.share_report(out, targets).filter(f"abs(n_tokens - target_share / 9000 * {total}) > 16 OR most_uses > 2").count() == 0
