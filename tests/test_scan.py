"""Bucketed scans, greedy suppression and trailing counts against plain Python."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import alerts as A
from tarnwatch.operators.scan import map_sorted_groups, running, time_bucket

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(i, at(t), s, "10.0.0.1", "DoS") for i, (t, s) in enumerate(rows)],
                                 "record_id long, ts timestamp, source_ip string, destination_ip string, attack_type string")


def test_running_matches_plain_prefix(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(0, 5000), rng.choice(["hot", "hot", "hot", "b"])) for _ in range(400)]
    df = events(spark, rows)
    out = running(df, ["source_ip"], ["ts", "record_id"], time_bucket("ts", 97),
                  {"n": ("count", F.lit(1)), "s": ("sum", F.col("record_id")), "m": ("max", F.col("record_id")),
                   "f": ("first", F.col("record_id"))})
    before = running(df, ["source_ip"], ["ts", "record_id"], time_bucket("ts", 97),
                     {"prev": ("last", F.col("record_id"))}, exclusive=True)
    got = {r["record_id"]: r for r in out.collect()}
    prev = {r["record_id"]: r["prev"] for r in before.collect()}
    seen = {}
    for i, (t, s) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        past = seen.setdefault(s, [])
        assert prev[i] == (past[-1] if past else None)
        past.append(i)
        assert (got[i]["n"], got[i]["s"], got[i]["m"], got[i]["f"]) == (len(past), sum(past), max(past), past[0])


def test_running_in_groups_of_buckets_is_the_same(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(0, 5000), rng.choice(["hot", "hot", None])) for _ in range(300)]
    df = events(spark, rows)
    specs = {"n": ("count", F.lit(1)), "s": ("sum", F.when(F.col("record_id") % 3 > 0, F.col("record_id"))), "m": ("min", F.col("record_id")),
             "f": ("first", F.col("record_id")), "l": ("last", F.col("record_id"))}
    for options in ({}, {"exclusive": True}):
        one, two = (running(df, ["source_ip"], ["ts", "record_id"], time_bucket("ts", 13), specs, group=g, **options) for g in (None, 7))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_map_sorted_groups_sees_whole_groups(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))

        def fn(rows, group):
            return pd.DataFrame([(int(p["k"].iloc[0]), len(p), bool(p["v"].is_monotonic_increasing))
                                 for _, p in rows.groupby(group)], columns=["k", "n", "ordered"])

        out = map_sorted_groups(df, ["k"], ["v"], fn, "k long, n long, ordered boolean").collect()
        assert sorted((r["k"], r["n"]) for r in out) == [(k, len(range(k, 200, 7))) for k in range(7)]
        assert all(r["ordered"] for r in out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def greedy(rows, window):
    kept, last = [], {}
    for i, (t, s) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if s not in last or t - last[s] >= window:
            last[s] = t
            kept.append(i)
    return sorted(kept)


def test_suppression_golden(spark):
    out = A.dedup_alerts(events(spark, [(t, "a") for t in (0, 100, 299, 300, 400, 700)]))
    assert sorted(r["record_id"] for r in out.collect()) == [0, 3, 5]


@pytest.mark.parametrize("seed,buckets", [(0, 2), (1, 3), (2, 64), (3, 2), (4, 5)])
def test_suppression_matches_greedy_loop(spark, seed, buckets):
    rng = random.Random(seed)
    # a dense hot key without any gap, and sparse ones
    rows = [(rng.randrange(0, 4000), "hot") for _ in range(300)]
    rows += [(rng.randrange(0, 40000), rng.choice("bcd")) for _ in range(80)]
    for group in (2, 3, 64):
        out = A.keep_spaced(events(spark, rows), A.DEDUP_KEY, 60, bucket_windows=buckets, group_buckets=group)
        assert sorted(r["record_id"] for r in out.collect()) == greedy(rows, 60)


def test_suppression_of_one_dense_key_follows_few_steps():
    """A bucket of 20 000 instants is a function of few steps, and composing buckets leaves fewer."""
    rng = np.random.default_rng(5)
    window, width = 1_000, 24_000
    steps = []
    for bucket in range(8):
        t = np.unique(rng.integers(bucket * width, (bucket + 1) * width, 4_000))
        entry = t[t - bucket * width < window]
        leave = entry.copy()
        for _ in range(24):
            at = np.searchsorted(t, leave + window)
            leave = np.where(at < len(t), t[np.minimum(at, len(t) - 1)], leave)
        ends = A._ends(leave)
        steps.append((entry[ends], leave[ends]))
    assert len(steps[0][0]) < 60
    last = steps[0][1]
    for limits, leave in steps[1:]:
        last = A._follow(limits, leave, last, window)
    assert len(np.unique(last)) <= 12


def test_trailing_counts_match_loop(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(0, 3000), rng.choice("aab")) for _ in range(300)]
    out = A.trailing_counts(events(spark, rows), A.DEDUP_KEY, 50, "n").collect()
    assert len(out) == 300
    for r in out:
        t, s = rows[r["record_id"]]
        assert r["n"] == sum(1 for u, v in rows if v == s and t - 50 <= u <= t)


def test_escalation(spark):
    df = events(spark, [(0, "a"), (300, "a"), (600, "a"), (1201, "a")]).withColumn("severity", F.lit("LOW"))
    got = {r["record_id"]: (r["escalated"], r["severity"]) for r in A.escalate_alerts(df).collect()}
    assert got == {0: (False, "LOW"), 1: (False, "LOW"), 2: (True, "CRITICAL"), 3: (False, "LOW")}


def test_suppression_keeps_rows_with_missing_keys(spark):
    rows = [(1, BASE, "a", None), (2, BASE + dt.timedelta(seconds=10), "a", None), (3, BASE, None, "DoS"), (4, BASE, "a", "DoS"),
            (5, BASE + dt.timedelta(seconds=400), "a", None)]
    df = spark.createDataFrame(rows, "record_id long, ts timestamp, source_ip string, attack_type string")
    kept = A.keep_spaced(df, ["source_ip", "attack_type"], 300)
    assert sorted(r.record_id for r in kept.collect()) == [1, 3, 4, 5]
