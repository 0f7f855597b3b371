import random

import numpy as np
import pytest

from rillstone.llm import neardup as N


def brute(records, num, den, least):
    sets = {k: set(N._WORDS.findall(t.lower())) for k, t in records if t}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * (num + den) >= num * (len(sets[a]) + len(sets[b]))}


def corpus(seed, n=220):
    r = random.Random(seed)
    frame = "after the cutover wrote rows into but only saw and of".split()
    names = [f"{a}{b}" for a in "ba ko li mu ne".split() for b in "ra so ti vu we xa zo".split()]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            words = r.choice(out)[1].split()
            for _ in range(r.randint(0, 4)):
                j = r.randrange(len(words))
                words[j : j + 1] = r.choice([[], [r.choice(names)], [words[j], r.choice(names)]])
                words = words or ["x"]
            r.shuffle(words)
        else:
            words = r.sample(frame, r.randint(2, len(frame))) + r.choices(names, k=r.randint(2, r.choice([8, 40])))
        out.append((f"r{i:03d}", " ".join(words)))
    return out


@pytest.mark.parametrize("num,den,least,seed", [(3, 5, 6, 1), (4, 5, 5, 2), (3, 5, 1, 3)])
def test_no_pair_is_lost(spark, num, den, least, seed):
    data = corpus(seed) + [("null", None), ("empty", ""), ("short", "a b"), ("up", corpus(seed)[0][1].upper())]
    df = spark.createDataFrame(data, "id string, text string").withColumnRenamed("id", "set_id")
    members, links = N.near_duplicates(df, "set_id", "text", num, den, least)
    assert {tuple(x) for x in N.record_pairs(members, links).collect()} == brute(data, num, den, least)


@pytest.mark.parametrize("plan", [N.Plan(1, (1, 1, 1, 1, 1)), N.Plan(4, (1, 1, 2, 2, 2)), N.Plan(5, (2, 2, 2, 1, 2)), N.Plan(6, (3, 2, 2, 2, 1)), N.Plan(3, (3, 1, 1, 1, 1))])
def test_every_plan_is_complete(spark, monkeypatch, plan):
    monkeypatch.setattr(N, "choose", lambda *_: plan)
    data = corpus(7, 120)
    members, links = N.near_duplicates(spark.createDataFrame(data, "id string, text string"), "id", "text", 3, 5, 6)
    assert {tuple(x) for x in N.record_pairs(members, links).collect()} == brute(data, 3, 5, 6)


def test_groups(spark):
    data = [("a", "one two three four five six"), ("b", "one two three four five six"), ("c", "one two three four five seven"), ("d", "one two three four eight seven"), ("e", "far away from all of these words")]
    members, links = N.near_duplicates(spark.createDataFrame(data, "id string, text string"), "id", "text", 3, 5, 6)
    got = {r["rec_id"]: (r["group_id"], r["n_links"]) for r in N.groups(members, links).collect()}
    assert len({got[x][0] for x in "abcd"}) == 1 and got["e"][0] != got["a"][0] and got["e"][1] == 0 and got["c"][1] == 2


def test_empty(spark):
    members, links = N.near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert N.record_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0


def test_choice_is_the_cheapest():
    r = np.random.default_rng(5)
    shape = (N.MAX_K + 1, N._PARTS, N.MAX_R + 1)
    pairs, rows = r.uniform(1, 100, shape), r.uniform(1, 100, shape)
    import itertools

    cost = lambda k, rs: sum(N.PAIR_COST * pairs[k, i, x] + rows[k, i, x] for i, x in enumerate(rs))
    best = min(cost(k, rs) for k in range(1, N.MAX_K + 1) for rs in itertools.product(range(1, N.MAX_R + 1), repeat=shape[1]) if sum(rs) - len(rs) <= k - 1)
    plan = N.choose(pairs, rows)
    assert cost(plan.k, plan.r) == pytest.approx(best) and sum(plan.r) - len(plan.r) <= plan.k - 1


def test_digest_is_a_lower_bound():
    r = random.Random(9)
    for _ in range(200):
        sets = [np.array(sorted({hash((r.random(),)) for _ in range(r.randint(1, 60))} | {7, 8, 9}), np.int64) for _ in range(2)]
        rows = np.concatenate([np.zeros(len(sets[0]), int), np.ones(len(sets[1]), int)])
        bits = N._digest(rows, np.concatenate(sets), 2)
        differ = sum(int(x[0] ^ x[1]).bit_count() if (x[0] ^ x[1]) >= 0 else (int(x[0] ^ x[1]) & (2**64 - 1)).bit_count() for x in bits)
        assert differ <= len(set(sets[0]) ^ set(sets[1]))


def test_correlated_words_share_a_group():
    r = np.random.default_rng(1)
    kind = r.integers(0, 2, 2000)
    held = np.zeros((2000, 20))
    for w in range(20):  # words 0 to 9 come from one phrasing, the others from another
        held[:, w] = (kind == w // 10) & (r.random(2000) < 0.7)
    group = N.correlated_groups(held.T @ held, 2000)
    assert len(set(group[:10])) == 1 and len(set(group[10:])) == 1 and group[0] != group[10]
    assert N.correlated_groups(np.array([[5.0]]), 9).tolist() == [0]
