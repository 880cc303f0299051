"""Queries on data quality, cleaning, encoding, scaling and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import prep as P
from tarnwatch.operators import quality as Q
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import duck, table, traffic

book = Book()
add = book.add
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def labelled(s, d):
    """lineitem as a labelled numeric dataset; some values are blanked out."""
    li = table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *NUM, "l_returnflag", "l_linestatus")


def gappy(s, d):
    li = labelled(s, d)
    return li.withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")),
        "l_discount": F.when(F.col("l_orderkey") % 11 == 0, float("inf")).when(
            F.col("l_orderkey") % 13 == 0, float("nan")).otherwise(F.col("l_discount")),
        "l_tax": F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")),
        "l_linestatus": F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linestatus"))})


_LAB = "lab AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"
_GAP = """gap AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 11 = 0 THEN 'infinity'::DOUBLE WHEN l_orderkey % 13 = 0 THEN 'nan'::DOUBLE ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS l_tax, l_returnflag,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus END AS l_linestatus FROM lineitem),
  fin AS (SELECT * REPLACE (CASE WHEN isfinite(l_discount) THEN l_discount END AS l_discount) FROM gap)"""
_COLS = ["l_orderkey", "l_linenumber", *NUM, "l_returnflag", "l_linestatus"]
DUP = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]

add("load_stats", lambda s, d: rounded(Q.load_stats(gappy(s, d).select("l_quantity", "l_tax", "l_returnflag", "l_linestatus"))),
    f"""WITH {_GAP}, g AS (SELECT l_quantity, l_tax, l_returnflag, l_linestatus, count(*) AS n FROM gap GROUP BY ALL),
     t AS (SELECT sum(n) AS rows, sum(n * ((l_quantity IS NULL)::INT + (l_tax IS NULL)::INT + (l_linestatus IS NULL)::INT)) AS nulls,
       sum(n - 1) AS dups FROM g)
     SELECT rows::BIGINT AS rows, nulls::BIGINT AS nulls, dups::BIGINT AS duplicates, round(dups * 100.0 / rows::DOUBLE, 6) AS duplicate_pct FROM t""")

add("standardize_features",
    lambda s, d: Q.standardize_features(traffic(s, d).select(
        F.col("protocol").alias("protocol_type"), F.col("packet_size").alias("src_bytes"), "record_id"),
        {"protocol_type": "protocol", "src_bytes": "source_bytes", "dst_bytes": "destination_bytes"}),
    duck("traffic", "SELECT protocol, packet_size AS source_bytes, record_id FROM traffic"))

add("missing_counts", lambda s, d: rounded(Q.handle_missing(Q.replace_infinite(gappy(s, d)), "log")),
    f"""WITH {_GAP} SELECT c AS "column", m AS missing, round(m * 100.0 / n::DOUBLE, 6) AS percent FROM (
      SELECT unnest(['l_quantity','l_discount','l_tax','l_linestatus']) AS c,
        unnest([count(*) - count(l_quantity), count(*) - count(l_discount), count(*) - count(l_tax), count(*) - count(l_linestatus)]) AS m,
        count(*) AS n FROM fin)""")
add("missing_dropped", lambda s, d: Q.handle_missing(Q.replace_infinite(gappy(s, d)), "drop").select("l_orderkey", "l_linenumber", "l_tax"),
    f"""WITH {_GAP} SELECT l_orderkey, l_linenumber, l_tax FROM fin WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
      AND l_tax IS NOT NULL AND l_linestatus IS NOT NULL""")
_FILL = """fi AS (SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT median(l_quantity) FROM fin)), 6) AS l_quantity,
  round(l_extendedprice, 6) AS l_extendedprice, round(coalesce(l_discount, (SELECT median(l_discount) FROM fin)), 6) AS l_discount,
  round(coalesce(l_tax, (SELECT median(l_tax) FROM fin)), 6) AS l_tax, l_returnflag,
  coalesce(l_linestatus, (SELECT l_linestatus FROM fin WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_linestatus
  FROM fin)"""
add("missing_filled", lambda s, d: rounded(Q.handle_missing(Q.replace_infinite(gappy(s, d)), "fill")),
    f"WITH {_GAP}, {_FILL} SELECT * FROM fi")
add("replace_infinite", lambda s, d: Q.replace_infinite(gappy(s, d)).select("l_orderkey", "l_linenumber", "l_discount"),
    f"WITH {_GAP} SELECT l_orderkey, l_linenumber, l_discount FROM fin")

add("quality_report",
    lambda s, d: Q.quality_report(labelled(s, d).select(*DUP).withColumn("fixed", F.lit("x")).withColumn(
        "l_tax", F.when(F.col("l_quantity") > 10, F.col("l_tax"))).withColumn(
        "code", F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string")))),
    """WITH q AS (SELECT l_quantity, l_discount, CASE WHEN l_quantity > 10 THEN l_tax END AS l_tax, l_returnflag, 'x' AS fixed,
        l_returnflag || l_quantity::INT AS code FROM lineitem)
      SELECT 'total_records' AS metric, '' AS item, count(*) AS value FROM q
      UNION ALL SELECT 'total_features', '', 6 UNION ALL SELECT 'missing_values', '', count(*) - count(l_tax) FROM q
      UNION ALL SELECT 'constant_column', 'fixed', 1
      UNION ALL SELECT 'duplicate_records', '', (SELECT count(*) FROM q) - (SELECT count(*) FROM (SELECT DISTINCT * FROM q))""")
add("quality_report_text",
    lambda s, d: Q.quality_report(table(s, d, "documents").select("text", "lang", "source")),
    """SELECT 'total_records' AS metric, '' AS item, count(*) AS value FROM documents
      UNION ALL SELECT 'total_features', '', 3
      UNION ALL SELECT 'missing_values', '', sum((text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT)::BIGINT FROM documents
      UNION ALL SELECT 'duplicate_records', '', (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents))
      UNION ALL SELECT 'high_cardinality_column', 'text', count(DISTINCT text) FROM documents HAVING count(DISTINCT text) > 0.5 * count(*)
      UNION ALL SELECT 'constant_column', c, 1 FROM (SELECT unnest(['text','lang','source']) AS c,
        unnest([count(DISTINCT text), count(DISTINCT lang), count(DISTINCT source)]) AS n FROM documents) WHERE n <= 1""")

_CAT = """CASE WHEN l IN ('neptune','smurf') THEN 'dos' WHEN l = 'satan' THEN 'probe' WHEN l = 'normal' THEN 'normal'
   WHEN l = 'guess_passwd' THEN 'r2l' WHEN l = 'rootkit' THEN 'u2r' ELSE 'unknown' END"""
_LBL = """CASE k % 7 WHEN 0 THEN 'normal' WHEN 1 THEN 'neptune' WHEN 2 THEN 'smurf' WHEN 3 THEN 'satan' WHEN 4 THEN 'guess_passwd'
   WHEN 5 THEN 'rootkit' ELSE 'never_seen' END"""


def _kdd(s, d):
    return traffic(s, d).select("record_id", F.expr(_LBL).alias("attack_type"), "protocol", "packet_size", "duration")


add("attack_category", lambda s, d: Q.add_attack_category(_kdd(s, d), "nsl_kdd").select("record_id", "attack_type", "attack_category"),
    duck("traffic", f"SELECT record_id, l AS attack_type, {_CAT} AS attack_category FROM (SELECT *, {_LBL} AS l FROM traffic)"))
add("dataset_statistics",
    lambda s, d: Q.dataset_statistics(Q.add_attack_category(_kdd(s, d), "nsl_kdd"), "attack_type", "attack_category"),
    duck("traffic", f"""WITH t AS (SELECT record_id, l AS attack_type, {_CAT} AS attack_category FROM (SELECT *, {_LBL} AS l FROM traffic))
      SELECT 'size' AS section, 'records' AS item, count(*) AS n FROM t UNION ALL SELECT 'size', 'features', 5
      UNION ALL SELECT 'missing', unnest(['record_id','attack_type','protocol','packet_size','duration','attack_category']), 0
      UNION ALL SELECT 'numeric', unnest(['record_id','packet_size','duration']), 1
      UNION ALL SELECT 'categorical', unnest(['protocol','attack_category']), 1
      UNION ALL SELECT 'label', attack_type, count(*) FROM t GROUP BY 2
      UNION ALL SELECT 'category', attack_category, count(*) FROM t GROUP BY 2"""))
add("check_ranges",
    lambda s, d: Q.check_ranges(traffic(s, d).select(
        (F.col("packet_size") - 300).alias("packet_length"), (F.col("k") - 10).alias("flag_count"), "duration")),
    duck("traffic", """SELECT 'packet_length' AS "column", count(*) AS negatives FROM traffic WHERE packet_size < 300
      UNION ALL SELECT 'flag_count', count(*) FROM traffic WHERE k < 10"""))
add("validate_packets",
    lambda s, d: Q.validate_packets(traffic(s, d).withColumns({
        "source_ip": F.when(F.col("k") % 9 == 0, F.concat("source_ip", F.lit(".1"))).otherwise(F.col("source_ip")),
        "source_port": F.when(F.col("k") % 8 == 0, F.col("source_port") + 65000).otherwise(F.col("source_port")),
        "packet_size": F.col("packet_size") - 200, "duration": F.col("duration") - 0.05}), ipv6=False)
    .select("record_id", F.array_join("errors", ",").alias("errors")),
    duck("traffic", """SELECT record_id, concat_ws(',', CASE WHEN k % 9 = 0 THEN 'source_ip' END,
      CASE WHEN k % 8 = 0 AND source_port + 65000 > 65535 THEN 'source_port' END,
      CASE WHEN packet_size - 200 < 0 THEN 'packet_size' END, CASE WHEN duration - 0.05::DOUBLE < 0 THEN 'duration' END) AS errors FROM traffic"""))
add("preprocess_for_ml",
    lambda s, d: rounded(Q.preprocess_for_ml(gappy(s, d).withColumn("attack_type", F.expr(
        "CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'N' THEN 'smurf' ELSE 'other' END"))
        .withColumn("difficulty_score", F.lit(1)), "nsl_kdd")),
    f"""WITH {_GAP}, {_FILL} SELECT *, CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'N' THEN 'smurf' ELSE 'other' END AS attack_type,
      CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'N' THEN 'dos' ELSE 'unknown' END AS attack_category FROM fi""")
add("sample_rows_stratified_counts",
    lambda s, d: Q.sample_rows(labelled(s, d).withColumn("id", F.expr("l_orderkey * 100 + l_linenumber")), 1000, "id", "l_returnflag")
    .groupBy("l_returnflag").agg(F.count("*").alias("n")),
    """WITH c AS (SELECT l_returnflag, count(*) AS c, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1),
      e AS (SELECT *, 1000 * c / t::DOUBLE AS x, floor(1000 * c / t::DOUBLE)::BIGINT AS q FROM c),
      r AS (SELECT *, row_number() OVER (ORDER BY q - x, l_returnflag) AS r, 1000 - sum(q) OVER () AS spare FROM e)
      SELECT l_returnflag, q + CASE WHEN r <= spare THEN 1 ELSE 0 END AS n FROM r""")
add("sample_rows",
    lambda s, d: Q.sample_rows(labelled(s, d).withColumn("id", F.expr("l_orderkey * 100 + l_linenumber")), 500, "id")
    .select("l_orderkey", "l_linenumber"))

# --- encoding, scaling, imputation ----------------------------------------------------------

add("encode_auto",
    lambda s, d: P.fit_encoder(traffic(s, d).select("protocol", "source_ip")).transform(
        traffic(s, d).select("record_id", "protocol", "source_ip")),
    duck("traffic", """WITH ips AS (SELECT source_ip, row_number() OVER (ORDER BY source_ip) - 1 AS code FROM (SELECT DISTINCT source_ip FROM traffic))
      SELECT record_id, (protocol = 'ICMP')::INT AS "protocol_ICMP", (protocol = 'TCP')::INT AS "protocol_TCP", (protocol = 'UDP')::INT AS "protocol_UDP",
        ips.code::INT AS source_ip FROM traffic t JOIN ips ON ips.source_ip = t.source_ip"""))
add("encode_label",
    lambda s, d: P.fit_encoder(traffic(s, d).select("protocol"), "label").transform(traffic(s, d).select("record_id", "protocol")),
    duck("traffic", "SELECT record_id, CASE protocol WHEN 'ICMP' THEN 0 WHEN 'TCP' THEN 1 ELSE 2 END AS protocol FROM traffic"))
add("encode_onehot_unknown",
    lambda s, d: P.fit_encoder(traffic(s, d).where("protocol <> 'ICMP'").select("protocol", "flags_csv"), "onehot", drop_first=True)
    .transform(traffic(s, d).select("record_id", "protocol", "flags_csv")),
    duck("traffic", """SELECT record_id, (protocol = 'UDP')::INT AS "protocol_UDP", (flags_csv = 'PSH,ACK')::INT AS "flags_csv_PSH,ACK",
      (flags_csv = 'RST')::INT AS "flags_csv_RST", (flags_csv = 'SYN')::INT AS "flags_csv_SYN", (flags_csv = 'SYN,ACK')::INT AS "flags_csv_SYN,ACK" FROM traffic"""))
add("encode_inverse",
    lambda s, d: (lambda e, t: e.inverse(e.transform(t)))(P.fit_encoder(traffic(s, d).select("protocol", "source_ip")),
                                                          traffic(s, d).select("record_id", "protocol", "source_ip")),
    duck("traffic", "SELECT record_id, protocol, source_ip FROM traffic"))


def _scaled(kind, **kw):
    return lambda s, d: rounded(P.fit_scaler(labelled(s, d), kind, NUM, **kw).transform(
        labelled(s, d)).select("l_orderkey", "l_linenumber", *NUM))


def _scale_sql(expr):
    return (f"WITH {_LAB} SELECT l_orderkey, l_linenumber, " +
            ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in NUM) + " FROM lab")


add("scale_standard", _scaled("standard"),
    _scale_sql("({c} - (SELECT avg({c}) FROM lab)) / (SELECT stddev_pop({c}) FROM lab)"))
add("scale_minmax", _scaled("minmax", feature_range=(-1.0, 1.0)),
    _scale_sql("({c} - (SELECT min({c}) FROM lab)) / (SELECT max({c}) - min({c}) FROM lab) * 2 - 1"))
add("scale_robust", _scaled("robust"),
    _scale_sql("({c} - (SELECT median({c}) FROM lab)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lab)"))
add("scale_inverse",
    lambda s, d: (lambda m, t: rounded(m.inverse(m.transform(t)), 4).select("l_orderkey", "l_linenumber", *NUM))(
        P.fit_scaler(labelled(s, d), "standard", NUM), labelled(s, d)),
    f"WITH {_LAB} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}, 4) AS {c}" for c in NUM) + " FROM lab")
add("scaling_statistics", lambda s, d: rounded(P.scaling_statistics(labelled(s, d), NUM), 4),
    f"WITH {_LAB} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM lab"""
        for c in NUM))
for _how, _sql in (("mean", "avg({c})"), ("median", "median({c})")):
    add(f"impute_{_how}",
        lambda s, d, h=_how: rounded(P.impute(Q.replace_infinite(gappy(s, d)), h, columns=["l_quantity", "l_tax"]).select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_tax")),
        f"WITH {_GAP} SELECT l_orderkey, l_linenumber, " + ", ".join(
            f"round(coalesce({c}, (SELECT {_sql.format(c=c)} FROM gap)), 6) AS {c}" for c in ("l_quantity", "l_tax")) + " FROM gap")
add("impute_constant",
    lambda s, d: P.impute(gappy(s, d), "constant", -1, ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"),
    f"WITH {_GAP} SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -1) AS l_quantity, coalesce(l_tax, -1) AS l_tax FROM gap")
add("impute_drop",
    lambda s, d: P.impute(gappy(s, d), "drop", columns=["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber"),
    f"WITH {_GAP} SELECT l_orderkey, l_linenumber FROM gap WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL")

# --- cleaning ----------------------------------------------------------------------------------

add("drop_duplicate_rows", lambda s, d: labelled(s, d).select(*DUP).dropDuplicates(),
    "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem")


def _names(fn):
    return lambda s, d: s.createDataFrame([(c,) for c in fn(s, d)], "feature string")


def _wide(s, d):
    t = labelled(s, d)
    return t.withColumns({
        "mostly_gone": F.when(F.col("l_orderkey") % 4 == 0, F.col("l_tax")), "nearly_fixed": F.when(F.col("l_orderkey") % 50 == 0, 2.0).otherwise(1.0),
        "mark": F.when(F.col("l_orderkey") % 40 == 0, "b").otherwise("a"), "flat": F.lit(3.5),
        "price2": F.col("l_extendedprice") * 2 + F.col("l_tax")}).drop("l_orderkey", "l_linenumber")


_WIDE = """w AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    CASE WHEN l_orderkey % 4 = 0 THEN l_tax END AS mostly_gone, CASE WHEN l_orderkey % 50 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS nearly_fixed,
    CASE WHEN l_orderkey % 40 = 0 THEN 'b' ELSE 'a' END AS mark, 3.5::DOUBLE AS flat, l_extendedprice * 2 + l_tax AS price2 FROM lineitem)"""
_WNUM = [*NUM, "mostly_gone", "nearly_fixed", "flat", "price2"]
_WALL = [*NUM, "l_returnflag", "l_linestatus", "mostly_gone", "nearly_fixed", "mark", "flat", "price2"]
add("high_missing_features", _names(lambda s, d: P.high_missing_features(_wide(s, d))),
    f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM w HAVING count({c}) < 0.5 * count(*)" for c in _WALL))
add("constant_features", _names(lambda s, d: P.constant_features(_wide(s, d))),
    f"WITH {_WIDE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM (SELECT count(*) AS n FROM w WHERE {c} IS NOT NULL GROUP BY {c}) HAVING max(n) >= 0.95 * (SELECT count(*) FROM w)" for c in _WALL))
add("top_value_shares", lambda s, d: rounded(P.top_value_shares(_wide(s, d).select("l_quantity", "l_returnflag", "mark"))),
    f"WITH {_WIDE} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(max(n) / (SELECT count(*) FROM w)::DOUBLE, 6) AS share FROM (SELECT count(*) AS n FROM w GROUP BY {c})"""
        for c in ("l_quantity", "l_returnflag", "mark")))
add("low_variance_features", _names(lambda s, d: P.low_variance_features(_wide(s, d), 0.001)),
    f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM w HAVING var_samp({c}) <= 0.001" for c in _WNUM))
add("correlated_features", _names(lambda s, d: P.correlated_features(_wide(s, d))),
    f"""WITH {_WIDE} SELECT DISTINCT feature FROM (""" + " UNION ALL ".join(
        f"SELECT '{b}' AS feature FROM w HAVING abs(corr({a}, {b})) > 0.95" for i, a in enumerate(_WNUM) for b in _WNUM[i + 1:]
        if "flat" not in (a, b)) + ")")
_OUT_NUM = ["l_extendedprice", "l_tax"]
for _m, _t in (("zscore", 1.5), ("iqr", 0.3)):
    _lo, _hi = (("(SELECT avg({c}) - 1.5 * stddev_pop({c}) FROM lab)", "(SELECT avg({c}) + 1.5 * stddev_pop({c}) FROM lab)") if _m == "zscore" else
                ("(SELECT quantile_cont({c}, .25) - 0.3 * (quantile_cont({c}, .75) - quantile_cont({c}, .25)) FROM lab)",
                 "(SELECT quantile_cont({c}, .75) + 0.3 * (quantile_cont({c}, .75) - quantile_cont({c}, .25)) FROM lab)"))
    add(f"remove_outliers_{_m}",
        lambda s, d, m=_m, t=_t: P.remove_outliers(labelled(s, d).select(*_OUT_NUM, "l_returnflag"), m, t),
        f"WITH {_LAB} SELECT l_extendedprice, l_tax, l_returnflag FROM lab WHERE " + " AND ".join(
            f"{c} BETWEEN {_lo.format(c=c)} AND {_hi.format(c=c)}" for c in _OUT_NUM))
add("clean_features",
    lambda s, d: P.fit_cleaner(_wide(s, d))[1],
    f"WITH {_WIDE} SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM (SELECT DISTINCT * FROM w)")
add("cleaning_statistics", lambda s, d: P.cleaning_statistics(_wide(s, d), P.fit_cleaner(_wide(s, d))[1]),
    f"""WITH {_WIDE} SELECT 'before' AS stage, count(*) AS rows, 11::BIGINT AS columns FROM w
      UNION ALL SELECT 'after', count(*), 6 FROM (SELECT DISTINCT * FROM w)""")

# --- balancing ----------------------------------------------------------------------------------


def _classes(s, d):
    t = traffic(s, d)
    return t.select("record_id", F.coalesce("attack_type", F.lit("normal")).alias("label"), F.col("packet_size").cast("double").alias("packet_size"), "duration")


_CL = "cl AS (SELECT record_id, coalesce(attack_type, 'normal') AS label FROM traffic), n AS (SELECT label, count(*) AS n FROM cl GROUP BY 1)"
add("random_oversample", lambda s, d: P.random_oversample(_classes(s, d), "label", "record_id"))
add("oversample_distribution",
    lambda s, d: P.distribution(_classes(s, d), P.random_oversample(_classes(s, d), "label", "record_id"), "label"),
    duck("traffic", f"WITH {_CL} SELECT label, n AS before, (SELECT max(n) FROM n) AS after FROM n"))
add("random_undersample", lambda s, d: P.random_undersample(_classes(s, d), "label", "record_id"))
add("undersample_distribution",
    lambda s, d: P.distribution(_classes(s, d), P.random_undersample(_classes(s, d), "label", "record_id"), "label"),
    duck("traffic", f"WITH {_CL} SELECT label, n AS before, (SELECT min(n) FROM n) AS after FROM n"))
add("smote", lambda s, d: P.smote(_classes(s, d), "label", "record_id", ["packet_size", "duration"]))
add("smote_distribution",
    lambda s, d: P.distribution(_classes(s, d), P.smote(_classes(s, d), "label", "record_id", ["packet_size", "duration"]), "label"),
    duck("traffic", f"WITH {_CL} SELECT label, n AS before, (SELECT max(n) FROM n) AS after FROM n"))
add("imbalance_ratio", lambda s, d: rounded(P.imbalance_ratio(_classes(s, d), "label")),
    duck("traffic", f"WITH {_CL} SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, round(min(n) / max(n)::DOUBLE, 6) AS ratio FROM n"))

QUERIES, ORACLE = book.queries, book.oracle
