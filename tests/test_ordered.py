"""Order-dependent operators against plain loops: the ledger and the sequential rule on long chains; grouping by Hamming distance."""
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gleanworks import ordering
from gleanworks.operators import dedup, graph, simjoin, usage


def loop(events, caps):
    """Outcome per seq by one pass in time order."""
    out, used, n, seen = {}, {}, {}, {}
    for seq, key, shop, period, amount, ts in sorted(events, key=lambda e: (e[5], e[0])):
        at, cap = (shop, period), caps[shop]
        if (at, key) in seen:
            out[seq] = ("duplicate", Decimal(0)) if seen[at, key] in ("included", "charged") else (seen[at, key], Decimal(0))
            continue
        if cap and used.get(at, 0) + amount > cap:
            got, charged = "capped", Decimal(0)
        elif n.get(at, 0) < 3:
            got, charged = "included", Decimal(0)
        else:
            got, charged = "charged", amount
        if got != "capped":
            n[at] = n.get(at, 0) + 1
        used[at] = used.get(at, 0) + charged
        seen[at, key] = got
        out[seq] = (got, charged)
    return out


def test_ledger_with_many_crossings_takes_a_fixed_number_of_passes(spark, monkeypatch):
    rng = random.Random(1)
    events, base = [], 1_700_000_000
    for i in range(1500):  # prices that keep shrinking cross the rest of the cap again and again
        price = Decimal(max(1, int(60_000 * 0.99**i) + rng.randint(0, 50))) / 10_000
        events.append((i, f"k{i % 1400}", "hot", "2024-01", price if i < 1400 else None, base + i))
    price_of = {e[1]: e[4] for e in events[:1400]}
    events = [(s, k, shop, p, a if a is not None else price_of[k], t) for s, k, shop, p, a, t in events]
    events += [(2000 + i, f"q{i}", f"s{i % 5}", "2024-01", Decimal("0.5"), base + i) for i in range(300)]
    caps = {"hot": Decimal(200), **{f"s{i}": Decimal(0 if i == 0 else 3 + i) for i in range(5)}}
    ev = spark.createDataFrame(events, "seq long, key string, shop string, period string, amount decimal(10,4), t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    subs = spark.createDataFrame([(s, "p", "sub", c) for s, c in caps.items()], "shop string, plan string, subscription_id string, capped_amount decimal(10,4)")
    cuts = []
    real = usage.cut_lineage
    monkeypatch.setattr(usage, "cut_lineage", lambda df: cuts.append(1) or real(df))
    got = {r.seq: (r.outcome, r.charged) for r in usage.usage_ledger(ev, subs, {"free": ("", 3, 0), "p": ("", 3, 1)}).collect()}
    want = loop(events, caps)
    assert got == want
    assert sum(o == "capped" and s < 1400 for s, (o, _) in want.items()) > 500
    assert len(cuts) <= 10


def kept_by_scan(n, edges):
    gone, before = set(), {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    for b in range(n):
        if any(a not in gone for a in before.get(b, [])):
            gone.add(b)
    return gone


def test_long_chains_are_decided_in_bounded_passes(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(600)] + [(i, i + rng.randint(2, 40)) for i in range(0, 500, 3)] + [(1000, b) for b in range(1001, 1200)]
    df = spark.createDataFrame(edges, "a long, b long")
    cuts = []
    real = graph.cut_lineage
    monkeypatch.setattr(graph, "components", lambda e: spark.createDataFrame([(i, 0) for i in range(700)] + [(i, 1000) for i in range(1000, 1300)], "node long, component long"))
    monkeypatch.setattr(graph, "cut_lineage", lambda x: cuts.append(1) or real(x))
    got = {r.node for r in graph.greedy_dropped(df, local_edges=80, rounds=2).collect()}
    assert got == kept_by_scan(1300, edges)
    assert len(cuts) <= 8 + 2 * (len(edges) // 80 + 1)  # two tables a range, whatever the chain's length


def test_a_row_with_many_neighbours_and_all_numbers_of_ranges(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(400)} | {(i, 119) for i in range(119)})
    df = spark.createDataFrame(edges, "a long, b long")
    for local in (7, 10_000):
        assert {r.node for r in graph.greedy_dropped(df, local_edges=local, rounds=1).collect()} == kept_by_scan(120, edges)


def components_of(values, k):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(values):
        for y in values[:i]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= k:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {v: find(v) for v in values}


@pytest.mark.parametrize("k", [2, 4, 7])
def test_groups_by_distance(spark, k):
    rng = random.Random(k)
    values = []
    for _ in range(25):
        v = rng.getrandbits(63)
        for _ in range(rng.randint(1, 12)):
            values.append(v)
            for bit in rng.sample(range(62), rng.randint(1, k + 1)):
                v ^= 1 << bit
    values = sorted(set(values))
    want = components_of(values, k)
    got = {r.node: r.component for r in simjoin.hamming_groups(spark.createDataFrame([(v,) for v in values], "h long"), k).collect()}
    alone = {v for v, c in want.items() if list(want.values()).count(c) == 1}
    assert {v: got[v] for v in want if v not in alone} == {v: c for v, c in want.items() if v not in alone}
    assert all(got.get(v, v) == v for v in alone)


def test_a_large_group_of_near_hashes_is_linear(spark):
    base = 0x5A5A_1234_9876_0F0F
    values = [base ^ (1 << i) ^ (1 << j) for i in range(62) for j in range(i)] + [base]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, h long")
    groups = dedup.image_groups(df)
    assert groups.select("component").distinct().count() == 1 and groups.count() == len(values)


@pytest.mark.parametrize("k", [4, 7])
def test_candidates_stay_in_proportion_to_the_number_of_values(k):
    for n in (10**4, 10**6, 10**8):
        masks = simjoin.hamming_levels(k, n, n)[0]
        bits = min(bin(m).count("1") for m in masks)
        # keys and expected chance pairs per value
        assert len(masks) <= 800 and len(masks) * n / 2 / 2**bits <= 2 * len(masks)


def test_chance_candidates_of_many_random_hashes(spark):
    n = 300_000
    h = spark.range(n).select(F.xxhash64("id").alias("h"))
    masks = simjoin.hamming_levels(4, n, n)[0]
    keys = h.select("h", F.explode(simjoin._mask_keys(F.col("h"), masks)).alias("key"))
    pairs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0]
    assert pairs <= 20 * n


def test_a_hot_group_within_one_day_is_cut_into_even_parts(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 50_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 400)).alias("shop"), F.col("id").alias("seq"),
                                      F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * F.col("id") * 13).alias("ts"))
    cut = ordering.time_cuts(rows, ["shop"], "ts", rows=2000)
    n = sorted(r["count"] for r in cut.where("shop = 'hot'").groupBy("_cut").count().collect())
    assert len(n) > 50 and n[-1] <= 2 * n[len(n) // 2]
    assert cut.where("shop <> 'hot'").select("_cut").distinct().collect() == [(0,)]
    ranked = ordering.rank_in_groups(cut, ["shop"], [F.col("ts"), F.col("seq")], F.col("_cut"), "rn").where("shop = 'hot'")
    assert ranked.where("rn <> seq + 1").count() == 0 and ranked.count() == 50_000
