"""Preparation: quantiles, encoding, scaling, cleaning, balancing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import prep as P
from tarnwatch.operators import quality as Q
from tarnwatch.operators.neighbours import nearest_sites
from tarnwatch.operators.quantiles import exact_quantiles


def test_narrowing_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=4000), np.full(2500, 0.25)]
    df = spark.createDataFrame([(float(v), float(-v * 3), None) for v in x], "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, direct_rows=0)
    assert got["a"] == pytest.approx(list(np.quantile(x, probs)))
    assert got["b"] == pytest.approx(list(np.quantile(-x * 3, probs)))
    assert got["c"] == [None] * 6
    assert exact_quantiles(df, ["a"], probs)["a"] == pytest.approx(list(np.quantile(x, probs)))


def frame(spark):
    return spark.createDataFrame([("tcp", "SF", "http", 1.0), ("udp", "S0", "ftp", 2.0), ("tcp", "SF", "ssh", 3.0), ("icmp", "REJ", "http", 4.0)],
                                 "protocol string, flag string, service string, duration double")


def test_encoder(spark, tmp_path):
    df = frame(spark)
    auto = P.fit_encoder(df, max_onehot=2)
    assert set(auto.strategies.values()) == {"label"}
    enc = P.fit_encoder(df)
    out = enc.transform(df)
    assert "protocol_tcp" in out.columns and "duration" in out.columns
    assert enc.inverse(out).select("protocol", "flag", "service").collect() == df.select("protocol", "flag", "service").collect()
    new = spark.createDataFrame([("sctp", "SF", "http", 1.0)], df.schema)
    assert enc.transform(new).select("protocol_tcp", "protocol_udp", "protocol_icmp").first()[:] == (0, 0, 0)
    enc.save(str(tmp_path / "e.json"))
    assert P.Encoder.load(str(tmp_path / "e.json")) == enc
    strict = P.fit_encoder(df, "label", handle_unknown="error")
    with pytest.raises(Exception, match="unknown category"):
        strict.transform(new).collect()
    dropped = P.fit_encoder(df, "onehot", drop_first=True)
    assert dropped.inverse(dropped.transform(df)).select("protocol").collect() == df.select("protocol").collect()


def test_encoder_dictionary(spark, tmp_path, monkeypatch):
    """Any number of categories: dense codes in order, unknown and NULL values, joined or sent around, saved with its table."""
    n = 100_000
    df = spark.range(n).select(F.concat(F.lit("10."), (F.col("id") * 7919 % n).cast("string")).alias("source_ip"),
                               F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("h"), F.col("id") % 80)).alias("host"), F.col("id").alias("n"))
    enc = P.fit_encoder(df)
    assert set(enc.sizes) == {"source_ip", "host"} and enc.categories == {}
    out = enc.transform(df)
    assert out.columns == df.columns and out.agg(F.min("source_ip"), F.max("source_ip"), F.countDistinct("source_ip")).first()[:] == (0, n - 1, n)
    order = {v: i for i, v in enumerate(sorted({f"10.{i}" for i in range(n)}))}
    rows = out.join(df.select("n", F.col("source_ip").alias("ip"), F.col("host").alias("h")), "n").where("n % 100 = 0").collect()
    hosts = sorted({f"h{i}" for i in range(80)})
    assert all(r.source_ip == order[r.ip] and r.host == (-1 if r.h is None else hosts.index(r.h)) for r in rows)
    assert enc.inverse(out).exceptAll(df).isEmpty()
    enc.save(str(tmp_path / "e"))
    again = P.Encoder.load(str(tmp_path / "e"))
    assert again.dictionary != enc.dictionary
    monkeypatch.setattr(P, "MAX_BROADCAST", 0)
    assert again.transform(df).exceptAll(out).isEmpty()
    new = spark.createDataFrame([("elsewhere", None, 1), ("10.5", "h7", 2)], df.schema)
    assert {r.n: (r.source_ip, r.host) for r in again.transform(new).collect()} == {1: (-1, -1), 2: (order["10.5"], hosts.index("h7"))}
    strict = P.fit_encoder(df.select("source_ip"), handle_unknown="error")
    with pytest.raises(Exception, match="unknown category"):
        strict.transform(new.select("source_ip")).collect()
    with pytest.raises(ValueError, match="one-hot"):
        P.fit_encoder(df.select("source_ip"), "onehot")
    assert again.transform(df.limit(0)).count() == 0


def test_any_number_of_classes(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 12_000).cast("string").alias("y"), F.col("id").cast("double").alias("x"))
    before = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    over = {r["y"]: r["count"] for r in P.random_oversample(df, "y", "id").groupBy("y").count().collect()}
    assert set(before.values()) == {2, 3} and set(over.values()) == {3} and len(over) == 12_000
    under = P.random_undersample(df, "y", "id")
    assert under.count() == 24_000 and under.select("id").distinct().count() == 24_000
    assert Q.sample_rows(df, 15_000, "id", "y").count() == 15_000
    assert P.smote(df, "y", "id", ["x"]).count() == 36_000


def test_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(P, "COPY_CHUNK", 50)
    df = spark.createDataFrame([(i, "many") for i in range(1234)] + [(9999, "rare")], "id long, y string")
    made = P.random_oversample(df, "y", "id")
    rare = made.where("y = 'rare'")
    assert [r._copy for r in rare.orderBy("_copy").collect()] == list(range(1234)) and made.columns == ["id", "y", "_copy"]
    assert rare.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_scaler(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(5)], "x double, fixed double")
    s = P.fit_scaler(df)
    rows = s.transform(df).orderBy("x").collect()
    assert rows[0]["x"] == pytest.approx(-2 / np.sqrt(2)) and rows[0]["fixed"] == 0.0
    s.save(str(tmp_path / "s.json"))
    assert P.Scaler.load(str(tmp_path / "s.json")).transform(df).collect() == s.transform(df).collect()
    assert [r["x"] for r in s.inverse(s.transform(df)).orderBy("x").collect()] == pytest.approx([0, 1, 2, 3, 4])
    m = P.fit_scaler(df, "minmax", feature_range=(-1, 1)).transform(df).agg(F.min("x"), F.max("x")).first()
    assert m[:] == (-1.0, 1.0)
    with pytest.raises(ValueError, match="Unsupported scaler type"):
        P.fit_scaler(df, "invalid")
    gaps = spark.createDataFrame([(None,), (2.0,)], "x double")
    assert P.impute(gaps, "mean").agg(F.sum("x")).first()[0] == 4.0
    with pytest.raises(ValueError, match="All rows were dropped"):
        P.impute(spark.createDataFrame([(None,)], "x double"), "drop")
    with pytest.raises(ValueError, match="Unsupported missing value strategy"):
        P.impute(gaps, "invalid")


def messy(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(100):
        a = float(rng.normal())
        rows.append((a, float(rng.normal()), 1.0, 1.0 if i < 95 else 2.0, a if i % 10 < 3 else None, 0.001 * (i % 2), a * 2 + 0.001 * float(rng.normal()),
                     1000.0 if i == 0 else float(rng.normal())))
    rows += rows[:5]
    return spark.createDataFrame(rows, "good1 double, good2 double, constant double, near_constant double, high_missing double,"
                                       " low_variance double, correlated double, outlier double")


def test_cleaner(spark, tmp_path):
    df = messy(spark)
    assert df.dropDuplicates().count() == 100
    assert P.high_missing_features(df) == ["high_missing"]
    assert {"constant"} <= set(P.constant_features(df)) and "good1" not in P.constant_features(df)
    assert "near_constant" in P.constant_features(df.dropDuplicates())
    assert set(P.low_variance_features(df, 0.01)) >= {"constant", "low_variance"}
    assert P.correlated_features(df.select("good1", "good2", "correlated")) == ["correlated"]
    assert P.remove_outliers(df.select("outlier")).count() < 105
    assert P.remove_outliers(df.select("outlier"), "iqr", 1.5).where("outlier > 900").count() == 0
    assert P.remove_outliers(df, "none").count() == 105
    cleaner, cleaned = P.fit_cleaner(df, outliers="zscore")
    assert "good1" in cleaned.columns and "correlated" not in cleaned.columns and "constant" not in cleaned.columns
    cleaner.save(str(tmp_path / "c.json"))
    assert P.Cleaner.load(str(tmp_path / "c.json")).transform(df).columns == cleaner.transform(df).columns
    wide = P.correlations(df.select("good1", "good2", "correlated", "outlier"), chunk=2)
    assert wide["good1", "correlated"] == pytest.approx(1.0, abs=1e-3)
    with pytest.raises(ValueError, match="empty"):
        P.fit_cleaner(df.limit(0))


def classes(spark):
    return spark.range(1000).select(
        F.col("id"), F.when(F.col("id") < 800, 0).when(F.col("id") < 950, 1).otherwise(2).alias("y"),
        (F.col("id") * 0.5).alias("f1"), (F.col("id") % 13).cast("double").alias("f2"))


def sizes(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_balancing(spark):
    df = classes(spark)
    assert sizes(P.random_oversample(df, "y", "id")) == {0: 800, 1: 800, 2: 800}
    assert sizes(P.random_oversample(df, "y", "id", "minority")) == {0: 800, 1: 150, 2: 800}
    assert sizes(P.random_oversample(df, "y", "id", {1: 300})) == {0: 800, 1: 300, 2: 50}
    assert sizes(P.random_oversample(df, "y", "id", 0.5)) == {0: 800, 1: 400, 2: 400}
    assert P.random_oversample(df, "y", "id").where("_copy = 0").count() == 1000
    under = P.random_undersample(df, "y", "id")
    assert sizes(under) == {0: 50, 1: 50, 2: 50} and under.select("id").distinct().count() == 150
    assert sorted(r[0] for r in under.select("id").collect()) == sorted(
        r[0] for r in P.random_undersample(df, "y", "id").select("id").collect())
    made = P.smote(df, "y", "id", ["f1", "f2"])
    assert sizes(made) == {0: 800, 1: 800, 2: 800}
    new = made.where("_synthetic AND y = 2").agg(F.min("f1"), F.max("f1")).first()
    assert new[0] >= 475.0 and new[1] <= 499.5
    assert P.is_imbalanced(df, "y") and P.imbalance_ratio(df.where("y = 0"), "y").first()["ratio"] == 1.0


def plain_neighbours(points, k):
    """Per distinct point (first row, weight, point): its k + 1 nearest points by (distance, first row)."""
    x = np.array([p for *_, p in points])
    first = np.array([f for f, *_ in points])
    out = {}
    for i in range(len(points)):
        d = sum(((x[i, c] - x[:, c]) / 1.0) ** 2 for c in range(x.shape[1]))
        order = np.lexsort((first, d))[:k + 1]
        out[first[i]] = [(float(d[j]), int(first[j])) for j in order]
    return out


@pytest.mark.parametrize("n, tile", [(1, 400), (4, 400), (500, 7), (500, 400), (6000, 50)])
def test_neighbours_are_exact(spark, n, tile):
    rng = np.random.default_rng(n + tile)
    x = np.unique(np.round(np.c_[rng.lognormal(0, 2, n), np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n)), rng.integers(0, 3, n)], 2), axis=0)
    points = [(int(f), 1, tuple(map(float, p))) for f, p in zip(rng.permutation(len(x)), x, strict=True)]
    rows = [(lab, f, w, int(f % 3 > 0), *p) for lab in ("a", "b") for f, w, p in points]
    sites = spark.createDataFrame(rows, "label string, _first long, _weight long, _make long, f0 double, f1 double, f2 double")
    got = {(r.label, r._first): [(s.distance, s.first) for s in r.near] for r in nearest_sites(sites, "label", ["f0", "f1", "f2"], dict.fromkeys(["f0", "f1", "f2"], 1.0), 5, tile).collect()}
    want = plain_neighbours(points, 5)
    assert got == {(lab, f): near for lab in ("a", "b") for f, near in want.items() if f % 3 > 0}


def test_smote_between_neighbours(spark):
    """Every synthetic row lies on the line to one of the k nearest rows; the wider column does not decide."""
    rng = np.random.default_rng(9)
    rows = [(i, "few", float(a), float(b)) for i, (a, b) in enumerate(np.c_[rng.normal(size=60), 1000 * rng.normal(size=60)])]
    rows += [(100 + i, "same", 1.0, 2.0) for i in range(30)] + [(200, "one", 5.0, 6.0), (201, "gap", None, 1.0), (202, "few", float("nan"), 1.0), (203, None, 1.0, 1.0)]
    rows += [(1000 + i, "many", float(i), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y string, a double, b double")
    made = P.smote(df, "y", "id", ["a", "b"], k=3)
    assert sizes(made) == {"few": 400, "same": 400, "one": 400, "many": 400, "gap": 1, None: 1}
    assert {(r.a, r.b) for r in made.where("y = 'same'").collect()} == {(1.0, 2.0)} and {(r.a, r.b) for r in made.where("y = 'one'").collect()} == {(5.0, 6.0)}
    x = np.array([r[2:] for r in rows[:60]])
    full = [(r[2], r[3]) for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]
    scale = np.std(np.array(full), axis=0)
    d = (((x[:, None] - x[None]) / scale) ** 2).sum(-1)
    near = np.argsort(d, axis=1)[:, 1:4]
    for r in made.where("y = 'few' AND _synthetic").collect():
        p = np.array([r.a, r.b])
        gaps = [min(np.abs((p - x[i]) / scale @ np.array([[0, 1], [-1, 0]]) @ ((x[j] - x[i]) / scale)) for j in near[i]) for i in range(60)]
        assert min(gaps) < 1e-9
    assert sorted(map(str, made.collect())) == sorted(map(str, P.smote(df, "y", "id", ["a", "b"], k=3).collect()))


def test_sampling(spark):
    df = classes(spark)
    assert sizes(Q.sample_rows(df, 100, "id", "y")) == {0: 80, 1: 15, 2: 5}
    assert Q.sample_rows(df, 37, "id").count() == 37
    assert Q.sample_rows(df, 5000, "id", "y").count() == 1000


def test_nan_is_a_gap_at_every_size(spark):
    values = [float("nan") if i % 4 == 0 else float(i) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = np.array([v for v in values if v == v])
    for direct in (0, 1_000_000):
        assert exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], direct_rows=direct)["x"] == pytest.approx(list(np.quantile(known, [0.25, 0.5, 0.75])))
    few = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert sorted(r.x for r in P.impute(few, "mean").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r.x for r in P.impute(few, "median").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r.x for r in P.impute(few, "drop").collect()) == [1.0, 3.0]
    assert P.fit_scaler(few).center["x"] == 2.0 and P.fit_scaler(few, "minmax").scale["x"] == 2.0
    assert P.remove_outliers(few, threshold=1.5).count() == 4


def test_quantiles_between_two_values_that_repeat(spark):
    # cuts around a rank fall on both sides of the border of two values that fill the bracket
    x = np.sort(np.r_[np.full(50_000, 25.0), np.full(50_000, 26.0), np.repeat([-np.inf, np.inf], 40)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(3)
    assert exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], direct_rows=0)["x"] == [25.0, 25.5, 26.0]
