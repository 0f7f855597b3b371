import random

from conftest import rows

from rillstone.operators import similarity as S


def make(spark, seed, n=60, words=14):
    r = random.Random(seed)
    data = [(i, sorted(set(r.choices([f"w{j}" for j in range(words)], k=r.randint(0, 9))))) for i in range(n)]
    return data, spark.createDataFrame(data, "item_id bigint, tokens array<string>")


def test_pairs(spark):
    data, df = make(spark, 1)
    sets = {i: set(t) for i, t in data}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    want = {(a, b) for a, b in pairs if sets[a] | sets[b] and len(sets[a] & sets[b]) * 20 >= 11 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in S.jaccard_pairs(df, 11, 20).collect()} == want
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 5 and len(sets[a] & sets[b]) * 5 >= 4 * min(len(sets[a]), len(sets[b]))}
    assert {(r["a"], r["b"]) for r in S.containment_pairs(df, 4, 5, 5).collect()} == want
    left, right = df.filter("item_id < 30"), df.filter("item_id >= 30")
    want = {(a, b) for a, b in pairs if a < 30 <= b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 3 * min(len(sets[a]), len(sets[b]))}
    assert {(r["a"], r["b"]) for r in S.overlap_pairs(left, right, 3, 5).collect()} == want


def test_clusters(spark):
    r = random.Random(3)
    n = 40
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.03]
    items, pairs = spark.createDataFrame([(i,) for i in range(n)], "item_id bigint"), spark.createDataFrame(edges, "a bigint, b bigint")
    groups: list[list[int]] = []
    for i in range(n):
        home = next((g for g in groups if any((min(i, m), max(i, m)) in edges for m in g)), None)
        groups.append([i]) if home is None else home.append(i)
    assert {(x["item_id"], x["cluster_id"]) for x in S.greedy(items, pairs).collect()} == {(i, g[0]) for g in groups for i in g}
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {(x["item_id"], x["cluster_id"]) for x in S.connected(items, pairs).collect()} == set(enumerate(label))


def test_report(spark):
    data = [("c", 1, "s1", "a b", ["a", "b"]), ("c", 2, "s1", "a c", ["a", "c"]), ("d", 3, "s2", "z", ["z"]), ("d", 4, "s3", "y", ["y"]), ("d", 5, "s3", "xx", ["xx"])]
    df = spark.createDataFrame(data, "cluster_id string, item_id bigint, session_id string, normalized string, tokens array<string>")
    assert rows(S.signatures(df)) == [("c", "a b c"), ("d", "y")]
    assert rows(S.cluster_report(df, 3)) == [("d", 3, 2, 3.0, "y")]
    empty = spark.createDataFrame([(1, []), (2, []), (3, ["a"]), (4, [])], "item_id bigint, tokens array<string>")
    assert rows(S.link_empty(empty)) == [(1, 2), (1, 4)]


def test_overlap_pairs_stay_where_they_meet(spark):
    """Each pair comes out of the join of postings at once: as many as there are, none is sent through a shuffle to be made distinct or verified."""
    r = random.Random(7)
    forms = [[f"f{i}x{j}" for j in range(9)] for i in range(60)]
    data = [(i, sorted({*r.choice(forms)[: r.randint(4, 9)], *(f"r{r.randrange(2000)}" for _ in range(r.randint(0, 6)))})) for i in range(500)]
    df = spark.createDataFrame(data, "item_id bigint, tokens array<string>")
    pairs = S.overlap_pairs(df.filter("item_id < 200"), df.filter("item_id >= 200"), 3, 5)
    sets = {i: set(t) for i, t in data}
    want = sorted((a, b) for a in range(200) for b in range(200, 500) if len(sets[a] & sets[b]) * 5 >= 3 * min(len(sets[a]), len(sets[b])))
    assert rows(pairs) == sorted(want, key=repr)
    assert len({t for _, t in data for t in t}) > S.FREQUENT
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
