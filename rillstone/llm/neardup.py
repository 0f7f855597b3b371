"""Near-duplicate records with small edits, by the generalised pigeonhole principle (problem 2).

A record is the set of its words, a sparse bit vector; Jaccard similarity of at least t bounds the Hamming distance of two sets by their
sizes. Words are grouped into partitions: frequent words by the correlation measured between them over all records, so that those of one phrasing
share a partition; the others, which hardly correlate, by hash. Among the rarest words of two similar records at least k are shared. If partition i is probed only for sets of r_i shared words, then
no pair is lost as long as the sum of (r_i - 1) is less than k: each pair must reach some r_i. The r_i are unequal, and are chosen together
with k by dynamic programming over the candidate counts that statistics of all records predict. Candidates are verified exactly.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.similarity import connected
from rillstone.runtime import materialise

log = logging.getLogger(__name__)
_WORDS = re.compile("[a-z0-9]+")
#: Counters of the frequency sketch; words that share one are ordered alike, which costs speed at most. Its size does not depend on the data.
SKETCH_BITS = 18
#: Partitions of the frequent words, by how they go together, and of the others; the largest k considered, and the largest r_i.
COMMON_PARTITIONS, RARE_PARTITIONS, MAX_K, MAX_R = 2, 3, 7, 3
_PARTS = COMMON_PARTITIONS + RARE_PARTITIONS
#: The most frequent words, whose correlation is measured over all records; a table of fixed size.
CORRELATED = 256
#: What a candidate costs, which its digest of bits mostly rejects where it is found, against one signature.
PAIR_COST = 1.0
#: A word in at least this share of the records is frequent.
FREQUENT = 1 / 400


def word_hashes(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``[a-z0-9]`` in the lower-cased text."""
    if not text:
        return np.empty(0, np.int64)
    words = set(_WORDS.findall(text.lower()))
    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """The chosen k, and r of each partition; the first ones hold the frequent words."""

    k: int
    r: tuple[int, ...]


def choose(pairs: np.ndarray, rows: np.ndarray, most: int = MAX_K) -> Plan:
    """``pairs[k, i, r]``: candidates expected from partition i if probed for r shared words under k; ``rows[k, i, r]``: signatures written.

    ``most`` is the number of words that any two similar records share; no larger k holds for all of them. For each k up to it the r_i with the smallest total cost and sum (r_i - 1) <= k - 1 are found by dynamic programming over the partitions.
    """
    best, chosen = math.inf, Plan(1, (1,) * pairs.shape[1])
    for k in range(1, min(MAX_K, most) + 1):
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for i in range(pairs.shape[1]):
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, rs) in table.items():
                for r in range(1, MAX_R + 1):
                    now = used + r - 1
                    c = cost + PAIR_COST * pairs[k, i, r] + rows[k, i, r]
                    if now <= k - 1 and (now not in step or c < step[now][0]):
                        step[now] = (c, (*rs, r))
            table = step
        cost, rs = min(table.values())
        if cost < best:
            best, chosen = cost, Plan(k, rs)
    return chosen


def overlap_needed(a: int, b: int, num: int, den: int) -> int:
    """Shared words two sets of a and b words need for a similarity of at least num/den."""
    return -(-num * (a + b) // (num + den))


def prefix_lengths(size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix lengths for k = 0, of the larger and of the smaller (or equal) record of a pair; add k."""
    return size - -(-num * size // den), size - -(-2 * num * size // (num + den))


def _cooccurrence(index: np.ndarray, size: int):
    """``i, j, n``: in how many records the i-th and the j-th of the most frequent words stand together; ``index`` maps slots to them, others to -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), np.int64)
        for batch in batches:
            lists = batch.column(0)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = index[_slot(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))]
            held = np.zeros((len(lists), size), np.float32)
            held[row[at >= 0], at[at >= 0]] = 1
            total += (held.T @ held).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(total[i, j])], names=["i", "j", "n"])

    return run


def correlated_groups(together: np.ndarray, n: int) -> np.ndarray:
    """The group of each word from the numbers of records that hold two words; the diagonal holds those of one. Correlations are phi coefficients; each
    group forms around a word, and these words are those least correlated with one another that keep most company."""
    own = np.diag(together).astype(float)
    spread = np.sqrt(np.maximum(own * (n - own), 1e-9))
    phi = (together * float(n) - np.outer(own, own)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0.0)
    seeds = [int(np.argmax(np.maximum(phi, 0).sum(1)))]
    while len(seeds) < min(COMMON_PARTITIONS, len(own)):
        company = np.maximum(phi, 0).sum(1) - len(own) * np.maximum(phi[:, seeds], 0).max(1)
        company[seeds] = -np.inf
        seeds.append(int(np.argmax(company)))
    group = np.argmax(phi[:, seeds], axis=1)
    group[seeds] = np.arange(len(seeds))
    for _ in range(4):  # a word moves to the group it goes with most on average
        means = np.stack([phi[:, group == g].mean(1) if (group == g).any() else np.full(len(own), -np.inf) for g in range(len(seeds))], 1)
        group = np.argmax(means, axis=1)
    return group


def _partition_table(sets: DataFrame, counts: np.ndarray, n: int, frequent: float) -> np.ndarray:
    """The partition of each slot of the sketch: the group of a frequent word, else one by hash."""
    table = (COMMON_PARTITIONS + (np.arange(len(counts)) * 0x9E3779B1 >> 7) % RARE_PARTITIONS).astype(np.int8)
    common = np.flatnonzero(counts >= frequent)
    table[common] = 0
    top = common[np.argsort(-counts[common], kind="stable")][:CORRELATED]
    if len(top) > 1:
        index = np.full(len(counts), -1, np.int16)
        index[top] = np.arange(len(top))
        found = sets.select("words").mapInArrow(_cooccurrence(index, len(top)), "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()  # at most 256 x 256 rows
        together = np.zeros((len(top), len(top)))
        together[found["i"].to_numpy(), found["j"].to_numpy()] = found["n"].to_numpy()
        table[top] = correlated_groups(together, n)
        log.info("%d frequent words in groups of %s", len(common), np.bincount(table[top], minlength=COMMON_PARTITIONS).tolist())
    return table


def _ordered(batch: pa.RecordBatch, column: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the batch's sets, rarest first within each: row, hash, frequency, rank."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    freq = counts[_slot(h)]
    order = np.lexsort((h, freq, row))
    row, h, freq = row[order], h[order], freq[order]
    rank = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return row, h, freq, rank


def _statistics(counts: np.ndarray, table: np.ndarray, num: int, den: int):
    """Per k, partition and r: the signatures written, and the records that signatures of the shorter prefixes are expected to meet."""
    parts = _PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hits = np.zeros((MAX_K + 1, parts, MAX_R + 1)), np.zeros((MAX_K + 1, parts, MAX_R + 1))
        for batch in batches:
            row, h, freq, rank = _ordered(batch, 0, counts)
            size = np.bincount(row, minlength=batch.num_rows)
            part = table[_slot(h)].astype(np.int64)
            large, small = prefix_lengths(size, num, den)
            for k in range(1, MAX_K + 1):
                inside = rank < large[row] + k
                held = np.bincount(row[inside] * parts + part[inside], minlength=batch.num_rows * parts).reshape(-1, parts)
                for r in range(1, MAX_R + 1):
                    rows[k, :, r] += _combinations(held, r).sum(0)
                inside = rank < small[row] + k
                hits[k, :, 1] += np.bincount(part[inside], weights=freq[inside], minlength=parts)
                # frequent words come in company: all their combinations are taken to be as common as their rarest word
                for g in range(COMMON_PARTITIONS):
                    common = inside & (part == g)
                    at, f = row[common], freq[common]
                    held0 = np.bincount(at, minlength=batch.num_rows)
                    after = (np.cumsum(held0)[at] - np.arange(len(at)) - 1) if len(at) else at
                    for r in range(2, MAX_R + 1):
                        hits[k, g, r] += float((f * _combinations(after, r - 1)).sum())
        out = [(k, i, r, rows[k, i, r], hits[k, i, r]) for k in range(1, MAX_K + 1) for i in range(parts) for r in range(1, MAX_R + 1)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["k", "i", "r", "n_rows", "n_hits"]), preserve_index=False)

    return run


def _combinations(n: np.ndarray, r: int) -> np.ndarray:
    out = np.ones(n.shape)
    for j in range(r):
        out = out * np.maximum(n - j, 0) / (j + 1)
    return out


def _signatures(plan: Plan, counts: np.ndarray, table: np.ndarray, num: int, den: int):
    names = ["sig", "set_id", "size_flag", "bits_0", "bits_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, freq, rank = _ordered(batch, 1, counts)
            size = np.bincount(row, minlength=batch.num_rows)
            part = table[_slot(h)].astype(np.int64)
            large, small = prefix_lengths(size, num, den)
            bits = _digest(row, h, batch.num_rows)
            keep = rank < large[row] + plan.k
            row, h, part, rank = row[keep], h[keep], part[keep], rank[keep]
            indexed = rank < small[row] + plan.k
            order = np.lexsort((rank, part, row))
            row, h, part, indexed = row[order], h[order], part[order], indexed[order]
            group = row * _PARTS + part
            sigs, rows_, both = [], [], []
            for i, r in enumerate(plan.r):
                at = np.flatnonzero(part == i)
                g, hh, ix = group[at], h[at].view(np.uint64), indexed[at]
                most = int(np.bincount(g).max()) if len(g) else 0
                for lags in combinations(range(1, max(most, 1)), r - 1):
                    last = lags[-1] if lags else 0
                    n = len(g) - last
                    if n <= 0:
                        continue
                    ok = g[:n] == g[last : last + n]
                    words = np.stack([hh[:n], *(hh[lag : lag + n] for lag in lags)])[:, ok]
                    words = np.sort(words, axis=0)
                    sig = np.full(words.shape[1], 0x9E3779B97F4A7C15 * (i * 8 + r + 1) & (2**64 - 1), np.uint64)
                    for w in words:
                        sig = (sig ^ w) * np.uint64(0xFF51AFD7ED558CCD)
                        sig ^= sig >> np.uint64(32)
                    sigs.append(sig.view(np.int64))
                    rows_.append(row[at][:n][ok])
                    # a signature serves the smaller side of a pair if all its words are in the shorter prefix
                    inside = ix[:n]
                    for lag in lags:
                        inside = inside & ix[lag : lag + n]
                    both.append(inside[ok])
            if not sigs:
                continue
            r_, s_, b_ = np.concatenate(rows_), np.concatenate(sigs), np.concatenate(both)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(s_), 100_000):
                cut = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(s_[cut]), pa.array(ids[r_[cut]], pa.int64()), pa.array((size[r_[cut]] * 2 + ~b_[cut]).astype(np.int32)), *(pa.array(x[r_[cut]]) for x in bits)], names=names)

    return run


def _digest(row: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """Each set's words thrown into 128 bits, as two longs. Two digests differ in no more bits than the sets do in words."""
    at = (h.view(np.uint64) >> np.uint64(11)) % np.uint64(128)
    out = []
    for half in (0, 1):
        mine = (at // np.uint64(64)) == half
        bits = np.zeros(n, np.uint64)
        np.bitwise_or.at(bits, row[mine], np.uint64(1) << (at[mine] % np.uint64(64)))
        out.append(bits.view(np.int64))
    return out


def _hasher(min_words: int):
    names = ["rec_id", "set_id", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sets = [], [], []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = word_hashes(text)
                if len(w) >= min_words:
                    ids.append(rec)
                    keys.append(xxhash.xxh3_64_intdigest(w.tobytes()) - 2**63)
                    sets.append(w)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=names)

    return run


def word_sets(records: DataFrame, rec_id: str, text: str, min_words: int) -> DataFrame:
    """``rec_id, set_id, words``: the hashed word set of each record with enough words; equal sets have equal ids."""
    return records.select(F.col(rec_id).cast("string"), text).mapInArrow(_hasher(min_words), "rec_id string, set_id bigint, words array<bigint>")


def similar_sets(sets: DataFrame, num: int, den: int, min_words: int = 1) -> DataFrame:
    """``set_a, set_b`` (``set_a < set_b``): all pairs of the distinct sets ``set_id, words`` with a Jaccard similarity of at least num/den. Each
    set has at least ``min_words`` words."""
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            total += np.bincount(_slot(flat), minlength=len(total))
            n += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["slot", "n"])

    merged = sets.select("words").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2^18 + 1 rows
    counts, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    if len(merged):
        n = int(merged.loc[merged["slot"] < 0, "n"].sum())
        held = merged[merged["slot"] >= 0]
        counts[held["slot"].to_numpy()] = held["n"].to_numpy()
    partitions = _partition_table(sets, counts, n, max(8.0, n * FREQUENT))
    stats = sets.select("words").mapInArrow(_statistics(counts, partitions, num, den), "k bigint, i bigint, r bigint, n_rows double, n_hits double")
    stats = stats.groupBy("k", "i", "r").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_hits").alias("n_hits")).collect()  # one row per k, partition and r
    pairs, rows = np.full((MAX_K + 1, _PARTS, MAX_R + 1), 1e18), np.full((MAX_K + 1, _PARTS, MAX_R + 1), 1e18)
    of = {(s["k"], s["i"], s["r"]): s for s in stats}
    for (k, i, r), s in of.items():
        rows[k, i, r] = s["n_rows"]
        if i < COMMON_PARTITIONS:
            pairs[k, i, r] = s["n_hits"] / 2
        else:  # words of a rare partition are met independently: shared ones follow a Poisson distribution
            mean = of[k, i, 1]["n_hits"] / max(n, 1) ** 2
            pairs[k, i, r] = max(0.0, 1 - sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(r))) * n**2 / 2
    plan = choose(pairs, rows, overlap_needed(min_words, min_words, num, den))
    log.info("%d sets, %s, expecting %s candidates", n, plan, [round(pairs[plan.k, i, r]) for i, r in enumerate(plan.r)])
    log.debug("candidates %s, signatures %s", pairs[1:, :, 1:].round().tolist(), rows[1:, :, 1:].round().tolist())
    signed = sets.select("set_id", "words").mapInArrow(_signatures(plan, counts, partitions, num, den), "sig bigint, set_id bigint, size_flag int, bits_0 bigint, bits_1 bigint")
    return _verified(_candidates(signed, num, den), sets, num, den)


def _candidates(signed: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of sets with a common signature whose sizes allow the similarity. The larger set probes with its longer prefix, the
    smaller one is found by its shorter prefix."""
    # each part of the condition names both sides, so nothing is filtered below the exchange and both sides read the same one
    differ = f"(bit_count(l.bits_0 ^ r.bits_0) + bit_count(l.bits_1 ^ r.bits_1)) * {num + den} > {den - num} * (l.size_flag DIV 2 + r.size_flag DIV 2)"
    fits = F.expr(
        f"CASE WHEN r.size_flag % 2 = 1 THEN false WHEN {differ} THEN false WHEN l.size_flag DIV 2 > r.size_flag DIV 2 THEN (r.size_flag DIV 2) * {den} >= (l.size_flag DIV 2) * {num} "
        "ELSE l.size_flag DIV 2 = r.size_flag DIV 2 AND l.set_id < r.set_id END"
    )
    left, right = signed.alias("l"), signed.alias("r")
    joined = left.join(right, F.expr("l.sig = r.sig") & fits)
    return joined.select(F.least("l.set_id", "r.set_id").alias("set_a"), F.greatest("l.set_id", "r.set_id").alias("set_b")).distinct()


def _verified(candidates: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("set_id").alias("set_a"), F.col("words").alias("words_a"))
    b = sets.select(F.col("set_id").alias("set_b"), F.col("words").alias("words_b"))
    both = candidates.join(a, "set_a").join(b, "set_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return both.filter(shared * (num + den) >= num * (F.size("words_a") + F.size("words_b"))).select("set_a", "set_b")


def near_duplicates(records: DataFrame, rec_id: str, text: str, num: int = 4, den: int = 5, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``rec_id, set_id`` of each record with at least ``min_words`` distinct words, and all links ``set_a, set_b`` between
    different word sets with a Jaccard similarity of at least num/den.

    Records with the same words, copies among them, share a ``set_id``. Null and short texts take part in nothing; a record that occurs with
    several texts belongs to several sets; an empty input gives no rows. No bucket is capped, so no link is lost.
    """
    hashed = word_sets(records, rec_id, text, min_words)
    members = materialise(hashed.select("rec_id", "set_id").distinct(), "members")
    sets = materialise(hashed.select("set_id", "words").groupBy("set_id").agg(F.first("words").alias("words")), "sets")
    return members, similar_sets(sets, num, den, max(1, min_words))


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``rec_a, rec_b`` (``rec_a < rec_b``): the pairs of records that links and equal sets stand for."""
    left, right = members.toDF("ra", "set_a"), members.toDF("rb", "set_b")
    across = links.join(left, "set_a").join(right, "set_b").filter("ra <> rb").select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))
    shared = members.groupBy("set_id").count().filter("count > 1").select("set_id")
    copies = members.join(shared, "set_id", "left_semi").select("rec_id", "set_id")
    same = copies.toDF("rec_a", "set_id").join(copies.toDF("rec_b", "set_id"), "set_id").filter("rec_a < rec_b").select("rec_a", "rec_b")
    return across.unionByName(same).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``rec_id, group_id, n_links``: connected groups of records, with the number of links each record's word set has."""
    label = connected(links.select(F.col("set_a").alias("item_id")).unionByName(links.select(F.col("set_b").alias("item_id"))).distinct(), links.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))
    degree = links.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    out = members.join(label.toDF("set_id", "label"), "set_id", "left").join(degree, "set_id", "left")
    return out.select("rec_id", F.coalesce("label", "set_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
