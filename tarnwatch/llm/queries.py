"""Registered queries of the training-data operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm import ann, audit, bpe, extract, jaccard, langid, linededup, mixing, packing, quality, revisits, toxicity, trie
from tarnwatch.llm.common import LOWER, UPPER, fold
from tarnwatch.session import prepare

#: Folder of the public vocabularies; a parameter of the engine, never part of it.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    model = langid.train(docs.where(langid.learnable(part, 2)))
    found = langid.identify(docs, model)
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(langid.learnable(fold(F.col("doc_id"), 5), 0))
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model)
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("_mx_topic").alias("topic"), F.col("_mx_tokens").alias("n_tokens"),
                        F.round("_mx_gain", 6).alias("gain"), F.round("_mx_prob", 6).alias("probability"), F.col("_mx_drawn").alias("drawn"))


def _one_of(marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains(text, '{m}')" for m in marks) + ")"


def op1_sql() -> str:
    topic = " ".join(f"WHEN {_one_of(marks)} THEN '{name}'" for name, marks in mixing.TOPICS.items())
    margins = ["source", "lang", "topic"]
    inner, prior = "r", "w"
    for i, m in enumerate(margins):
        where = f" WHERE step < {mixing.SWEEPS}" if not i else ""
        inner = f"(SELECT *, {prior} * goal_{m} / sum({prior}) OVER (PARTITION BY {m}) AS w{i} FROM {inner}{where})"
        prior = f"w{i}"
    goals = "\n".join(f"JOIN (SELECT {m}, power(sum(tokens), {mixing.FLATTEN}) / sum(power(sum(tokens), {mixing.FLATTEN})) OVER () AS goal_{m} "
                      f"FROM cells GROUP BY {m}) USING ({m})" for m in margins)
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source AS s0, lang AS l0, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang,
           CASE {topic} ELSE '{mixing.REST}' END AS topic, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens FROM documents),
    cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
    r AS (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, tokens AS w, 0 AS step FROM cells {goals}
          UNION ALL SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, {prior} AS w, step + 1 FROM {inner}),
    g AS (SELECT *, w / tokens AS gain FROM r WHERE step = {mixing.SWEEPS}),
    f AS (SELECT coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
                 sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, sum(tokens) OVER () * {mixing.KEEP} AS b
          FROM g WINDOW o AS (ORDER BY gain DESC, source, lang, topic)),
    p AS (SELECT source, lang, topic, gain * (SELECT sum(tokens) FROM g) AS gain,
                 least(1.0, gain * greatest(0, (SELECT max((b - s) / w) FROM f WHERE w > 0))) AS prob FROM g)
    SELECT doc_id, s0 AS source, l0 AS lang, d.topic, n_tokens, round(coalesce(gain, 0), 6) AS gain, round(coalesce(prob, 0), 6) AS probability,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / pow(16, 13) < coalesce(prob, 0) AS drawn
    FROM d LEFT JOIN p USING (source, lang, topic)"""


#: Captures derived from the pages table: a full response and two revisits of each page, one of them before it for some.
CAPTURES = """
    SELECT page_id * 3 + n AS record_id, url, TIMESTAMP '2024-01-01 00:00:00' + (minutes + CASE n WHEN 0 THEN 0 WHEN 1 THEN (1 + page_id % 50) * 1440
             ELSE CASE WHEN page_id % 7 = 0 THEN -1440 ELSE 86400 END END) * INTERVAL '1' MINUTE AS captured_at,
           CASE n WHEN 0 THEN 'response' ELSE 'revisit' END AS type, CASE n WHEN 0 THEN 200 ELSE 304 END AS status,
           CASE WHEN n = 0 THEN tag WHEN n = 1 THEN 'W/' || tag WHEN page_id % 5 = 0 THEN '"stale"' WHEN page_id % 5 = 1 THEN NULL ELSE tag END AS etag,
           CASE WHEN n = 0 OR page_id % 10 = 1 THEN CAST(minutes AS {string}) END AS modified,
           CASE n WHEN 0 THEN 'max-age=60' WHEN 1 THEN 'max-age=600' END AS cache,
           CASE n WHEN 0 THEN 'text/html' ELSE 'text/plain' END AS kind,
           CASE WHEN n = 0 THEN html END AS payload
    FROM (SELECT page_id, url, html, (page_id * 7919) % 100000 AS minutes, concat('"', substr(md5(html), 1, 16), '"') AS tag FROM pages),
         (SELECT {range} AS n)"""


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rows = CAPTURES.format(string="STRING", range="0").split("FROM (SELECT page_id")[0] + """
        FROM (SELECT *, (page_id * 7919) % 100000 AS minutes, concat('"', substr(md5(html), 1, 16), '"') AS tag FROM {pages})
        LATERAL VIEW explode(array(0, 1, 2)) x AS n"""
    captures = spark.sql(rows, pages=pages).withColumn("headers", F.map_from_entries(F.filter(F.array(
        *[F.struct(F.lit(name).alias("key"), F.col(c).alias("value")) for name, c in (
            ("ETag", "etag"), ("Last-Modified", "modified"), ("Cache-Control", "cache"), ("Content-Type", "kind"))]),
        lambda h: h["value"].isNotNull())))
    found = revisits.resolve(captures)
    value = lambda name: F.try_element_at("headers", F.lit(name))
    return found.select("record_id", "url_key", "outcome", "refers_to", value("etag").alias("etag"), value("last-modified").alias("modified"),
                        value("cache-control").alias("cache"), value("content-type").alias("kind"),
                        F.sha2(F.encode("payload", "utf-8"), 256).alias("payload_sha256"))


def op4_sql() -> str:
    return f"""
    WITH c AS ({CAPTURES.format(string="VARCHAR", range="unnest([0, 1, 2])")}),
    b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
    q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\\?(.*)$', 1), '&'),
                 lambda x: x <> '' AND NOT regexp_matches(x, '{revisits.TRACKING}'))) AS params FROM b),
    k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')
                 || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
                 || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM q),
    f AS (SELECT *, row_number() OVER (PARTITION BY url_key, captured_at ORDER BY record_id DESC) AS nth FROM k WHERE type = 'response' AND payload IS NOT NULL),
    j AS (SELECT r.*, f.record_id AS s_id, f.etag AS s_etag, f.modified AS s_modified, f.cache AS s_cache, f.kind AS s_kind, f.payload AS s_payload
          FROM (SELECT * FROM k WHERE type = 'revisit') r ASOF LEFT JOIN (SELECT * FROM f WHERE nth = 1) f
          ON r.url_key = f.url_key AND r.captured_at > f.captured_at),
    o AS (SELECT *, CASE WHEN s_id IS NULL THEN 'missing'
                 WHEN etag IS NOT NULL AND s_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(s_etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
                 WHEN modified = s_modified THEN 'resolved' WHEN modified <> s_modified THEN 'changed' ELSE 'unverified' END AS outcome FROM j)
    SELECT record_id, url_key, outcome, s_id AS refers_to,
           CASE WHEN outcome = 'resolved' THEN coalesce(etag, s_etag) ELSE etag END AS etag,
           CASE WHEN outcome = 'resolved' THEN coalesce(modified, s_modified) ELSE modified END AS modified,
           CASE WHEN outcome = 'resolved' THEN coalesce(cache, s_cache) ELSE cache END AS cache,
           CASE WHEN outcome = 'resolved' THEN s_kind ELSE kind END AS kind,
           CASE WHEN outcome = 'resolved' THEN sha256(s_payload) END AS payload_sha256 FROM o"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.filter_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sql() -> str:
    values = {"symbols": "n_symbols / n_words", "repeats": "n_repeat_words / n_words", "duplicate_lines": "n_dup_lines / n_lines",
              "long_words": "word_chars / n_words", "short_words": "-word_chars / n_words"}
    longest, n_sets = max(map(len, quality.LADDERS.values())), 2 ** len(quality.LADDERS) - 1
    taken = {r: f"len(list_filter({cs}::DOUBLE[], lambda c: {values[r]} > c))" for r, cs in quality.LADDERS.items()}
    first = ", ".join(f"CASE {taken[r]} WHEN 0 THEN {longest} ELSE {len(cs)} - {taken[r]} END" for r, cs in quality.LADDERS.items())
    over = " OR ".join(f"(c.st >> {i} & 1 = 1 AND coalesce({v} > {quality.LADDERS[r]}[least(c.step, {len(quality.LADDERS[r]) - 1}) + 1], false))"
                       for i, (r, v) in enumerate(values.items()))
    p = quality.RISK
    return f"""
    WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM i),
    v AS (SELECT doc_id, least(3, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9)) AS n FROM g WHERE c > 1),
    m AS (SELECT w.doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN (SELECT doc_id, sum(n) AS n FROM v GROUP BY doc_id) r ON r.doc_id = w.doc_id),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    h AS (SELECT lang, [{first}] AS first, quality FROM b JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
    n AS (SELECT lang, sum(quality)::BIGINT AS n FROM h GROUP BY lang),
    e AS (SELECT *, unnest(range(1, {n_sets + 1})) AS st FROM h),
    f AS (SELECT lang, st, quality, unnest(range(list_min(list_transform(first, lambda m, i: CASE WHEN st >> (i - 1)::INT & 1 = 1 THEN m ELSE {longest} END)), {longest})) AS step FROM e),
    k AS (SELECT f.lang, st, step, n, count(*) FILTER (quality = 1) AS k, count(*) FILTER (quality = 0) AS hit
          FROM f JOIN n ON f.lang IS NOT DISTINCT FROM n.lang GROUP BY ALL),
    s AS (SELECT *, n > 0 AND k <= n * {p} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                 + j * ln({p}) + (n - j) * ln(1 - {p})))) <= {quality.DELTA} / ((SELECT count(*) FROM n) * {n_sets}) AS passes FROM k),
    c AS (SELECT lang, st, step FROM s WHERE passes AND hit > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY hit DESC, step, bit_count(st), st) = 1),
    x AS (SELECT doc_id, bool_or({over}) AS rejected FROM b JOIN c ON b.lang IS NOT DISTINCT FROM c.lang WHERE NOT base_failed GROUP BY doc_id)
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM b LEFT JOIN x ON b.doc_id = x.doc_id"""


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_ld_n_lines").alias("n_lines"), F.col("_ld_n_dropped").alias("n_dropped"),
                        F.sha2(F.encode("_ld_kept", "utf-8"), 256).alias("kept_sha256"))


OP8_SQL = f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
    often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    r AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS lost FROM k LEFT JOIN often o ON k.key = o.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM r GROUP BY doc_id"""


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


def op10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("_ex_text").alias("text"), F.length("_ex_text").cast("long").alias("n_chars"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP11_SQL = """
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, good, toxic, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
                 coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m GROUP BY ALL),
    f(i, letter) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS idx
          FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    x AS (SELECT part, good, toxic, n, filter_order, step, idx[step] AS f, fails[idx[step]] AS failed, len(list_filter(fails, lambda y: y)) = 1 AS alone,
                 len(list_filter(idx[1:step - 1], lambda k: fails[k])) > 0 AS gone FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept,
                 sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failed THEN n ELSE 0 END)::BIGINT AS redundant,
                 sum(CASE WHEN failed AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN NOT gone AND failed AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
                 sum(CASE WHEN NOT gone AND failed AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
    SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), WORD_BPE)
    return packed.select("doc_id", F.col("_pk_piece").alias("piece"), F.col("_pk_start").alias("start"), F.col("_pk_length").cast("long").alias("length"),
                         F.col("_pk_crc32").alias("ids_crc32"), F.col("_pk_sequence").alias("sequence_id"), F.col("_pk_offset").alias("offset"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(read(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal digits of c, byte by byte and bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""

OP13_SQL = f"""
    WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT c, count(*) AS own, c - c % 20 AS base, {_CRC32} % 4 AS h FROM t GROUP BY c),
    m AS (SELECT k.*, least(h, (SELECT count(*) FROM t WHERE t.c = k.base)) AS m FROM k),
    u AS (SELECT m.c, pos, role, text FROM m JOIN t ON t.c = m.base AND pos <= h
          UNION ALL SELECT m.c, pos - h + m, role, text FROM m JOIN t ON t.c = m.c AND pos > h),
    n AS (SELECT c, count(*) AS length FROM u GROUP BY c),
    p AS (SELECT c, pos AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
                 list((role, text)) OVER (PARTITION BY c ORDER BY pos) AS prefix FROM u
          UNION ALL SELECT c, 0, 0, [] FROM m),
    q AS (SELECT p.c, depth, words, min(p.c) OVER w AS conv_id, count(*) OVER w AS n_convs, depth = coalesce(length, 0) AS ends
          FROM p LEFT JOIN n ON n.c = p.c WINDOW w AS (PARTITION BY depth, prefix)),
    v AS (SELECT conv_id, depth, any_value(words) AS words, any_value(n_convs) AS n_convs, max(n_convs) = count(*) FILTER (ends) AS leaf,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY conv_id, depth),
    e AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS below, b.depth AS deep FROM q a JOIN q b ON a.c = b.c AND a.depth <= b.depth),
    s AS (SELECT e.conv_id, e.depth, count(*) FILTER (e.deep = e.depth + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves,
                 sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM e JOIN v ON v.conv_id = e.below AND v.depth = e.deep GROUP BY ALL),
    x AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS parent_conv_id FROM q a JOIN q b ON a.c = b.c AND a.depth = b.depth + 1)
    SELECT v.conv_id, v.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM v JOIN s ON s.conv_id = v.conv_id AND s.depth = v.depth LEFT JOIN x ON x.conv_id = v.conv_id AND x.depth = v.depth"""


QUERIES = {"op1_mixing": op1_mixing, "op2_neighbours": op2_neighbours, "op3_bpe": op3_bpe, "op4_revisits": op4_revisits, "op5_language": op5_language,
           "op6_toxicity": op6_toxicity, "op7_quality": op7_quality, "op8_lines": op8_lines, "op9_jaccard": op9_jaccard, "op10_text": op10_text,
           "op11_audit": op11_audit, "op12_packing": op12_packing, "op13_trie": op13_trie}
SQL: dict[str, str] = {"op1_mixing": op1_sql(), "op4_revisits": op4_sql(), "op7_quality": op7_sql(), "op8_lines": OP8_SQL, "op11_audit": OP11_SQL,
                       "op13_trie": OP13_SQL}
