"""Correlation against plain Python loops that follow the rule definitions literally."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.operators import correlate as C
from tarnwatch.operators import graph
from tarnwatch.operators.graph import chained_components, connected_components

BASE = dt.datetime(2024, 1, 1)
TYPES = ["Probe", "Port Scan", "Brute Force", "Malware", "Command Control", "DoS", "DDoS", "Odd"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL", "weird"]


def make(spark, rows):
    df = spark.createDataFrame(
        [(i, BASE + dt.timedelta(seconds=t), s, d, k, 0.8, v) for i, (t, s, d, k, v) in enumerate(rows)],
        "event_id long, ts timestamp, source_ip string, destination_ip string, attack_type string, confidence_score double, severity string")
    return C.with_stage(df)


def not_falling(window, level):
    kept, high = [], -1
    for e in window:
        if level(e) is not None and level(e) >= high:
            kept.append(e[0])
            high = level(e)
    return kept if len(kept) >= 2 else []


def similar(a, b):
    return a == b or any(a in g and b in g for g in K.SIMILAR_ATTACKS)


def naive_rule(rows, rule):
    stage = lambda e: K.KILL_CHAIN_STAGES.index(K.ATTACK_STAGE[e[4]]) if e[4] in K.ATTACK_STAGE else None
    sev = lambda e: K.SEVERITY_ORDER.index(e[5].lower()) if e[5].lower() in K.SEVERITY_ORDER else None
    ordered = sorted(((i, *r) for i, r in enumerate(rows)), key=lambda e: (e[1], e[0]))
    out = {}
    for n, e in enumerate(ordered):
        window = [o for o in ordered[:n + 1] if o[1] >= e[1] - rule.window_seconds
                  and (not rule.same_source or o[2] == e[2]) and (not rule.same_target or o[3] == e[3])]
        if rule.multiple_sources and len({o[2] for o in window}) < 2:
            continue
        found = {e[0]}
        if rule.sequence:
            step, hits = 0, []
            for o in window:
                if step < len(rule.sequence) and o[4] == rule.sequence[step]:
                    hits.append(o[0])
                    step += 1
            if step == len(rule.sequence):
                found |= set(hits)
        if rule.kill_chain:
            found |= set(not_falling(window, stage))
        if rule.escalating:
            found |= set(not_falling(window, sev))
        if rule.similar_types:
            found |= {o[0] for o in window if similar(o[4], e[4])}
        order = {o[0]: p for p, o in enumerate(ordered)}
        matched = sorted(found, key=order.get)[-rule.max_events:]
        if len(matched) >= rule.min_events:
            out[e[0]] = matched
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rules_match_literal_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 60_000), rng.choice(["h", "h", "b", "c"]), rng.choice("xy"), rng.choice(TYPES), rng.choice(SEVERITIES))
            for _ in range(250)]
    df = make(spark, rows)
    rules = [C.DEFAULT_RULES[0], C.DEFAULT_RULES[1], C.DEFAULT_RULES[2],
             C.CorrelationRule("small", 3_000, 2, 4, same_source=True, kill_chain=True, escalating=True)]
    got = {(r["rule_id"], r["event_id"]): list(r["matched"]) for r in C.apply_rules(df, rules).collect()}
    want = {(rule.rule_id, k): v for rule in rules for k, v in naive_rule(rows, rule).items()}
    assert got == want


@pytest.mark.parametrize("seed,hosts", [(0, "hhbc"), (1, "h"), (2, "hb")])
def test_candidates_and_sequences_match_literal_loops(spark, seed, hosts):
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 300) * 60, rng.choice(hosts), rng.choice("xy"), rng.choice(TYPES[:4]), "LOW") for _ in range(300)]
    df = make(spark, rows)
    ordered = sorted(((i, *r) for i, r in enumerate(rows)), key=lambda e: (e[1], e[0]))
    for rule in (*C.DEFAULT_RULES[:3], C.CorrelationRule("twice", 1_800, 1, 9, ("Probe", "Probe", "Malware"), same_target=True)):
        counts, matches = {}, {}
        for n, e in enumerate(ordered):
            window = [o for o in ordered[:n + 1] if o[1] >= e[1] - rule.window_seconds
                      and (not rule.same_source or o[2] == e[2]) and (not rule.same_target or o[3] == e[3])]
            several = len({o[2] for o in window}) > 1
            counts[e[0]] = (len(window) - 1 if several or not rule.multiple_sources else 0, several)
            hits = []
            for o in window:
                if len(hits) < len(rule.sequence) and o[4] == rule.sequence[len(hits)]:
                    hits.append(o[0])
            if hits and len(hits) == len(rule.sequence):
                matches[e[0]] = hits
        assert {r["event_id"]: (r["candidates"], r["multiple_sources"]) for r in C.rule_candidates(df, rule).collect()} == counts
        if rule.sequence:
            assert {r["event_id"]: list(r["matched"]) for r in C.match_sequence(df, rule).collect()} == matches


def test_candidates_of_no_events(spark):
    df = make(spark, [(0, "a", "x", "DoS", "LOW")]).where("event_id < 0")
    assert C.rule_candidates(df, C.DEFAULT_RULES[0]).count() == 0 and C.match_sequence(df, C.DEFAULT_RULES[0]).count() == 0


def test_rule_without_conditions_yields_nothing(spark):
    df = make(spark, [(i, "a", "x", "DoS", "LOW") for i in range(5)])
    assert C.apply_rules(df).where("rule_id = 'lateral_movement'").count() == 0


def test_kill_chain_golden(spark):
    df = make(spark, [(i * 900, "a", "x", k, "LOW") for i, k in enumerate(["Probe", "Brute Force", "Malware", "Command Control"])])
    assert C.kill_chain_progression(df).count() == 4


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(200)]
    edges += [(5000, 5001 + i) for i in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in list(parent)}


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_chained_components_match_union_find(spark, batch):
    rng = random.Random(4)
    lists = [[rng.randrange(300) for _ in range(rng.randrange(0, 4))] for _ in range(180)]
    lists += [list(range(1000 + 3 * i, 1005 + 3 * i)) for i in range(60)] * 2
    lists += [None, [], [2000, None, 2001], [None, None], [2**60, 2**60, -5], [-5, 2002]]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for ids in lists:
        for a in ids or []:
            if a is not None:
                root(a)
        for a, b in zip(ids or [], (ids or [])[1:], strict=False):
            if a is not None and b is not None:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = chained_components(spark.createDataFrame([(x,) for x in lists], "ids array<long>"), "ids").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(parent)
    assert {r["node"]: r["component"] for r in rows} == {n: root(n) for n in list(parent)}


def test_sequences_search_parts_not_events(spark, monkeypatch):
    # overlapping matches of one long chain are one part for each batch, not a link for each event
    df = make(spark, [(i * 60, "a", "x", "Probe", "LOW") for i in range(2_000)])
    searched = []

    def counted(edges, *columns):
        searched.append(edges.count())
        return connected_components(edges, *columns)

    monkeypatch.setattr(graph, "connected_components", counted)
    monkeypatch.setattr(C, "connected_components", counted)
    members = C.sequence_members(C.apply_rules(df, C.DEFAULT_RULES[1:2]), df)
    assert members.select("sequence_id").distinct().collect() == [(0,)] and members.count() == 2_000
    assert sum(searched) < 200


def test_sequences_share_events(spark):
    rows = [(0, "a", "x", "Probe", "LOW"), (60, "a", "x", "Port Scan", "LOW"), (120, "a", "x", "Brute Force", "HIGH"),
            (180, "a", "x", "Malware", "HIGH"), (90_000, "b", "x", "Probe", "LOW"), (90_060, "b", "x", "Port Scan", "LOW"),
            (90_120, "b", "x", "Brute Force", "LOW")]
    df = make(spark, rows)
    members = C.sequence_members(C.apply_rules(df, C.DEFAULT_RULES[:1]), df)
    got = {r["sequence_id"]: r for r in C.describe_sequences(members).collect()}
    assert {k: r["event_count"] for k, r in got.items()} == {0: 4, 4: 3}
    assert got[0]["stages"] == [0, 3, 4]
    assert got[0]["progression_score"] == pytest.approx(0.7 + 0.3 * 3 / 7)
    assert "4 events over 0:03:00 involving 4 attack types: Brute Force, Malware, Port Scan and 1 others" in got[0]["description"]


def test_similarity_blocking_loses_nothing(spark):
    rng = random.Random(5)
    rows, owner = [], []
    for q in range(40):
        t0, n = rng.randrange(0, 6 * 86_400), rng.randrange(1, 4)
        for _ in range(n):
            rows.append((t0 + rng.randrange(0, 1000), rng.choice("abcde"), rng.choice("xyz"), rng.choice(TYPES[:5]), "LOW"))
            owner.append(q)
    members = make(spark, rows).withColumn("sequence_id", F.element_at(F.array(*map(F.lit, owner)), (F.col("event_id") + 1).cast("int")))
    seqs = C.describe_sequences(members)
    got = {(r["a"], r["b"]): r["similarity"] for r in C.sequence_similarity(seqs, members).collect()}
    info = {}
    for (t, s, d, k, _), q in zip(rows, owner):
        x = info.setdefault(q, [t, set(), set(), set()])
        x[0] = min(x[0], t)
        x[1].add(s), x[2].add(d), x[3].add(k)
    jac = lambda p, q: len(p & q) / len(p | q)
    want = {}
    for a in info:
        for b in info:
            if a < b:
                p, q = info[a], info[b]
                score = (.3 * jac(p[1], q[1]) + .2 * jac(p[2], q[2]) + .3 * jac(p[3], q[3])
                         + .2 * max(0, 1 - abs(p[0] - q[0]) / 86_400))
                if score > 0.6:
                    want[a, b] = score
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    camp = C.group_campaigns(C.sequence_similarity(seqs, members))
    assert camp.groupBy("campaign_id").count().where("count < 3").count() == 0


def test_similarity_of_large_sets(spark, monkeypatch):
    # the same pairs and scores whether sets travel with their sequence or stay in long form
    rng = random.Random(8)
    rows = [(rng.randrange(0, 2 * 86_400), rng.choice("abc"), rng.choice("wxyz"), rng.choice(TYPES[:4]), "LOW") for _ in range(160)]
    members = make(spark, rows).withColumn("sequence_id", F.pmod(F.xxhash64("event_id"), F.lit(25)))
    seqs = C.describe_sequences(members)
    found = []
    for size in (64, 3, 0):
        monkeypatch.setattr(C, "SMALL_SET", size)
        similar = C.sequence_similarity(seqs, members).collect()
        found.append({(r["a"], r["b"]): round(r["similarity"], 9) for r in similar})
        assert len(found[-1]) == len(similar)
    assert found[0] and found[0] == found[1] == found[2]


def test_similarity_moves_no_candidates(spark):
    members = make(spark, [(i, "a", "x", "Probe", "LOW") for i in range(3)]).withColumn("sequence_id", F.col("event_id"))
    plan = C.sequence_similarity(C.describe_sequences(members), members)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Relation" in plan


def test_similarity_looks_at_bounds_first(spark):
    # sets are intersected above the join, for pairs within the bounds, not for every pair of a key
    members = make(spark, [(i, "a", "x", "Probe", "LOW") for i in range(3)]).withColumn("sequence_id", F.col("event_id"))
    plan = C.sequence_similarity(C.describe_sequences(members), members)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all("bit_count" in line for line in joins)
    assert "array_intersect" in plan and not any("array_intersect" in line or "arrays_overlap" in line for line in joins)


def test_similarity_deals_frequent_keys(spark, monkeypatch):
    key = ["k1", "k2", "slot"]
    rows = spark.range(40).select(*[F.lit(1).cast("long").alias(k) for k in key], "id", F.struct(F.col("id").alias("sequence_id")).alias("own_b"))
    monkeypatch.setattr(C, "SHARE", 10)
    a, b = C._shares(rows, rows, key)
    sizes = [r["count"] for r in b.groupBy("share").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 40
    pairs = a.select(*key, "share", "id").join(b.select(*key, "share", F.col("id").alias("other")), [*key, "share"])
    assert pairs.count() == pairs.distinct().count() == 1600

    rng = random.Random(9)
    rows = [(rng.randrange(0, 86_400), rng.choice("ab"), rng.choice("xy"), rng.choice(TYPES[:3]), "LOW") for _ in range(120)]
    members = make(spark, rows).withColumn("sequence_id", F.pmod(F.xxhash64("event_id"), F.lit(40)))
    seqs = C.describe_sequences(members)
    found = []
    for share, size in ((4096, 64), (3, 64), (3, 0)):
        monkeypatch.setattr(C, "SHARE", share)
        monkeypatch.setattr(C, "SMALL_SET", size)
        similar = C.sequence_similarity(seqs, members).collect()
        found.append({(r["a"], r["b"]): round(r["similarity"], 9) for r in similar})
        assert len(found[-1]) == len(similar)
    assert found[0] and found[0] == found[1] == found[2]


def test_similar_types(spark):
    pairs = [("DoS", "DDoS", True), ("Probe", "Port Scan", True), ("R2L", "Brute Force", True), ("DoS", "Probe", False), ("Odd", "Odd", True)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    assert df.where((C.similar_group("a") == C.similar_group("b")) != F.col("ok")).count() == 0
