"""Line dedup, Jaccard join, mixture, rules, revisits and neighbours against plain versions on small fixtures."""

import datetime as dt
import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import ann, jaccard, linededup, mixing, quality, queries, revisits
from tarnwatch.session import prepare

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
DOCS = "doc_id long, text string, lang string, source string, hash string, pos string"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", "s", "clash", "clash") for i, t in rows], DOCS)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, min_docs=3):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-(2**63) if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    common, other = "This line is in very many documents", "Äußerst häufige Zeile in Texten"
    rows = [(i, f"start {i}\n  {common.upper()}\t\nshort\n{common}") for i in range(9)]
    rows += [(10, None), (11, ""), (None, common + "\n" + other), (12, other), (13, other + "\n\n" + other), (13, other + "\nsame id"), (14, "\n"), (14, "\n"), (3, common)]
    docs = frame(spark, rows)
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = linededup.drop_lines(docs, batches=batches, fanout=fanout)
        assert set(docs.columns) <= set(got.columns)
        assert sorted(((r.doc_id, r._ld_n_lines, r._ld_n_dropped, r._ld_kept) for r in got.collect()), key=str) == plain_lines(rows)
    named = docs.withColumns({c: F.concat(F.lit(c), F.lit("!")) for c in ("drops", "kept", "n_lines", "n_dropped", "last", "batch", "line", "key")})
    again = linededup.drop_lines(named)
    assert all(r[c] == c + "!" for r in again.collect() for c in named.columns[-8:])
    assert sorted(((r.doc_id, r._ld_n_lines, r._ld_n_dropped, r._ld_kept) for r in again.collect()), key=str) == plain_lines(rows)
    assert linededup.drop_lines(docs.limit(0)).count() == 0


def test_runs_tell_new_lines_from_known(spark):
    runs = linededup.Runs(spark, fanout=2)
    for ids in ([1, 2], [2, 3], [3, 4]):
        runs.add(spark.createDataFrame([(bytes([i]), 10 * i + len(runs.all())) for i in ids], "hash binary, _ld_id long"))
    assert {(r.hash[0], r.docs) for r in runs.totals().collect()} == {(1, 1), (2, 2), (3, 2), (4, 1)}
    assert {r.hash[0] for r in runs.levels[0][0].where("new").collect()} == {4}


def plain_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    return sorted(((i, len(s), min((j for j in least[find(x)] if j is not None), default=None)) for x, (i, s) in enumerate(sets)), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_jaccard_on_chains_and_borders(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows, passage = [], [f"p{i}" for i in range(60)]
    for i in range(60):  # a chain: each a little further from the first
        base = base[:]
        base[rng.randrange(len(base))] = f"new{i}"
        rows.append((i, " ".join(base)))
    for i in range(60, 140):  # share a long passage, at every degree around the threshold
        rows.append((i, " ".join(passage + [rng.choice(words) for _ in range((i - 60) // 4)])))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "TWO  words"), (205, "two"), (206, "a b c d"), (207, "A B\tc d"), (208, "two\xa0words")]
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    docs = frame(spark, rows)
    for width, percent in ((4, 85), (5, 80), (4, 60)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, width=width, percent=percent).collect())
        assert got == plain_components(rows, width, percent)
    assert jaccard.components(docs.limit(0)).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    text = "one two three four five six"
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, [(7, text), (None, text), (5, text), (5, "x"), (None, None)])).collect()}
    assert got == {(7, 3, 5), (None, 3, 5), (5, 3, 5), (5, 1, 5), (None, 0, None)}


@pytest.mark.parametrize("changed, with_base", [(3, True), (1, False)])
def test_families_are_joined_by_few_checks(spark, monkeypatch, changed, with_base):
    """Variants of one text, near it but not near one another, or near all others: checks grow with their number."""
    chance = random.Random(changed)
    base = [f"w{k}" for k in range(160)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(1, 400):
        words = list(base)
        for k, at in enumerate(chance.sample(range(len(words)), changed)):
            words[at] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    asked = []
    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda docs, held, pairs, width, percent: (asked.append(pairs.count()), real(docs, held, pairs, width, percent))[1])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows)).collect())
    assert got == sorted(plain_components(rows, 4, 85)) and len({c for *_, c in got}) == 1
    assert sum(asked) < 4000, asked


def made_by_joins(plan):
    """The most rows that a join of an executed plan made."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return made_by_joins(plan.executedPlan())
    if "QueryStage" in name:
        return made_by_joins(plan.plan())
    below = plan.children()
    most = max([0, *(made_by_joins(below.apply(i)) for i in range(below.size()))])
    return max(most, plan.metrics().apply("numOutputRows").value()) if "Join" in name else most


def test_jaccard_near_misses_meet_by_few_tokens(spark, monkeypatch):
    # variants of one text that link to none, as each one's own words take too many of its shingles, and some that do link
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = base.copy()
        for k, at in enumerate(rng.sample(range(4, 116, 8), 4 if i % 16 else 1)):
            words[at] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    real, made = jaccard.cross_pairs, []

    def watched(tokens, percent):
        pairs = real(tokens, percent)
        found = pairs.collect()
        made.append(made_by_joins(pairs._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(found, pairs.schema)

    monkeypatch.setattr(jaccard, "cross_pairs", watched)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows)).collect())
    assert got == sorted(plain_components(rows, 4, 85))
    assert 1 < len({c for *_, c in got}) < len(rows)
    assert made[0] < 4000, made


@needs_data
def test_op9_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in queries.read(spark, SF, "documents").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op9_jaccard(spark, SF).collect())
    assert got == plain_components(rows, 4, 85)


def test_mixture_meets_targets(spark):
    rows = [(i, "word " * (1 + i % 7), ["en", "de", None][i % 3], ["big", "big", "big", "a", "b"][i % 5], "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    goal = {"source": {"big": 1, "a": 1, "b": 2}, "lang": {"en": 0.5, "de": 0.25, None: 0.25}}
    cells = mixing.sample(docs, targets=goal, keep=0.1).groupBy("_mx_source", "_mx_lang").agg(
        F.sum(F.col("_mx_prob") * F.col("_mx_tokens")).alias("t"), F.sum("_mx_tokens").alias("all"), F.sum(F.col("_mx_drawn").cast("int")).alias("n")).collect()
    total = sum(r.t for r in cells)
    assert math.isclose(total, 0.1 * sum(r["all"] for r in cells), rel_tol=1e-6)
    for name, want in (("big", 0.25), ("a", 0.25), ("b", 0.5)):
        assert math.isclose(sum(r.t for r in cells if r._mx_source == name) / total, want, rel_tol=1e-5)
    for name, want in (("en", 0.5), ("de", 0.25), (mixing.NONE, 0.25)):
        assert math.isclose(sum(r.t for r in cells if r._mx_lang == name) / total, want, rel_tol=1e-5)
    assert 0 < sum(r.n for r in cells) < 3000


def test_mixture_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, "", ""), (None, "x", "en", "s", "", ""), (3, "", "en", "t", "", ""), (1, "y" * 500, "en", "s", "", "")], DOCS)
    got = mixing.sample(docs, keep=1.0).collect()
    assert len(got) == 4 and all(r._mx_prob == 1.0 for r in got if r._mx_tokens) and not any(r._mx_drawn for r in got if not r._mx_tokens)
    assert mixing.sample(docs.limit(0)).count() == 0
    assert not any(r._mx_drawn for r in mixing.sample(docs, targets={"source": {"unknown": 1.0}}).collect())


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 7, 20, 21, 300, 5000) for p in (0.01, 0.2) for k in {0, n // 200, int(n * p)}]
    for p in (0.01, 0.2):
        rows = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in rows.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(p) + (r.n - j) * math.log1p(-p)) for j in range(r.k + 1))
            assert math.isclose(r.t, want, rel_tol=1e-9)


def plain_metrics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i:i + 3])].append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics_and_cutoffs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [None, "", "a", "a b", "a a a a", "x y z\nx y z\n x y z", "é 漢 😀|", " \x0b\f# \r\n#\n#"]
    texts += [" ".join(word() for _ in range(80)) for _ in range(900)] + [" ".join(word() + "%%" for _ in range(80)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en" if i % 50 else None, "s", "", "") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 908)) for i in range(8, 1008)] + [(None, 1), (5000, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.filter_rules(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_metrics(t)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    assert all(got[i].kept for i in range(8, 908)) and not any(got[i].kept for i in range(8))
    assert [got[i].kept for i in range(908, 1008)] == [i % 50 == 0 for i in range(908, 1008)]  # too few labels of the null stratum
    assert quality.filter_rules(docs.limit(0), labels).count() == 0 and quality.filter_rules(docs, labels.limit(0)).where("kept").count() > 900


def test_rules_of_a_stratum_share_one_risk(spark):
    """Each rule rejects 0.6 % of the good texts, others than the other rule: one may be on, not both."""
    cols = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    odd = lambda i: (300, 0) if i % 2 else (0, 90)  # symbols in 100 words, duplicates of 100 lines
    rows = [(i, None if i % 3 else "en", 100, 500, *((odd(i // 250)[0], 100, odd(i // 250)[1]) if i % 250 < 3 else (0, 100, 0)), 0, False) for i in range(60_000)]
    rows += [(60_000 + i, None if i % 3 else "en", 100, 500, odd(i)[0], 100, odd(i)[1], 0, False) for i in range(600)]
    measured = spark.createDataFrame(rows, cols)
    labels = spark.createDataFrame([(i, int(i < 60_000)) for i in range(60_600)], "doc_id long, quality int")
    limits = quality.cutoffs(measured, labels)
    assert {r.stratum for r in limits.collect()} == {None, "en"} and limits.groupBy("stratum").count().where("count <> 1").isEmpty()
    judged = quality.judge(measured, limits)
    lost = judged.where("doc_id < 60000").groupBy("stratum").agg(F.avg(F.expr("cast(not kept as int)")).alias("lost")).collect()
    assert all(0 < r.lost <= quality.RISK for r in lost)
    assert judged.where("doc_id >= 60000 and not kept").count() > 250


def test_revisits(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "record_id long, url string, captured_at timestamp, type string, status int, headers map<string,string>, payload string, s string"
    rows = [
        (1, "http://www.A.example:80/x/?b=2&a=1&utm_source=q#top", day(0), "response", 200, {"ETag": '"one"', "Content-Type": "text/html"}, "old", ""),
        (2, "https://a.example/x?a=1&b=2", day(5), "response", 200, {"etag": 'W/"two"', "Cache-Control": "a", "Content-Type": "text/html"}, "new", ""),
        (3, "https://a.example/x?a=1&b=2", day(6), "response", 404, {"etag": '"two"'}, "no", ""),
        (4, "https://a.example/x?a=1&b=2", day(7), "revisit", 304, {"ETag": '"two"', "cache-control": "b", "Content-Type": "none"}, None, ""),
        (5, "a.example/x?b=2&a=1", day(3), "revisit", 304, {"ETAG": '"one"'}, None, ""),
        (6, "a.example/x?b=2&a=1", day(5), "revisit", 304, {"etag": '"two"'}, None, ""),  # not earlier than record 2
        (7, "a.example/x?b=2&a=1", day(9), "revisit", 304, None, None, ""),
        (8, "a.example/none", day(9), "revisit", 304, {"etag": '"two"'}, None, ""),
        (9, None, day(9), "revisit", 304, {"etag": '"two"'}, None, ""),
        (10, "a.example/x?b=2&a=1", None, "revisit", 304, {"etag": '"two"'}, None, ""),
    ]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r.outcome, r.refers_to, r.payload) for i, r in got.items()} == {
        4: ("resolved", 2, "new"), 5: ("resolved", 1, "old"), 6: ("changed", 1, None), 7: ("unverified", 2, None),
        8: ("missing", None, None), 9: ("missing", None, None), 10: ("missing", None, None)}
    assert got[4].headers == {"etag": '"two"', "cache-control": "b", "content-type": "text/html"}
    assert revisits.resolve(spark.createDataFrame(rows, schema).limit(0)).count() == 0
    hot = [(i, "h.example/", day(0) + dt.timedelta(hours=i), "response" if i % 5 == 0 else "revisit", 200, {"etag": f'"{i // 10}"'}, "p", "") for i in range(400)]
    found = {r.record_id: (r.refers_to, r.outcome) for r in revisits.resolve(spark.createDataFrame(hot, schema)).collect()}
    assert found == {i: (i - i % 5, "resolved") for i in range(400) if i % 5}


def exact_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {q: [int(i) for i in ids[np.lexsort((ids, -np.round(x @ v, 12)))] if i != q][:k] for q, v in zip(ids.tolist(), x) if q % 50 == 0}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # one very common vector
    odd = [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (2150, [None] + [1.0] * 7), (2200, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=200).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
    want = exact_neighbours(rows, 5)
    assert set(found) == set(want) and all(len(set(v)) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) > 0.95
    assert found[1000] == [3, 1001, 1002, 1003, 1004] and found[1050] == [3, 1000, 1001, 1002, 1003]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], df.schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


@needs_data
def test_op2_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.read(spark, SF, "embeddings").collect()]
    found = defaultdict(set)
    for r in queries.op2_neighbours(spark, SF).collect():
        found[r.query_id].add(r.vec_id)
    want = exact_neighbours(rows, 5)
    assert np.mean([len(found[q] & set(want[q])) / 5 for q in want]) >= 0.9
