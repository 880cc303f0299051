"""Encoding, language, toxicity and extraction against plain versions, round trips and held-out rows."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnwatch.llm import bpe, extract, langid, queries, toxicity
from tarnwatch.llm.common import fold
from tarnwatch.session import prepare

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(queries.BYTE_BPE), reason="vocabulary not available")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    texts = [None, "", " \t\n", "a", "Hello,  world's\n end<|endoftext|> ", "x" * 5000 + " été 漢字 😀", "Hello,  world's\n end<|endoftext|> ", "!!! 123"]
    return spark.createDataFrame([(i if i != 3 else None, t, None, None, None, "clash") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_BPE)


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("abcAB 's'll \n\t\x1c\x85\xa0é漢😀!?-12٣ 　<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_tokenizer(tokenizer, text):
    codec = bpe.codec(queries.BYTE_BPE)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


@needs_vocabulary
@pytest.mark.parametrize("text", ["a" * 40_000, "é" * 3_000, " " * 2_000 + "x", "ab" * 9_000 + "\n" * 500])
def test_long_fragments(tokenizer, text):
    assert bpe.codec(queries.BYTE_BPE).encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_bpe_frames(spark, docs):
    encoded = bpe.encode(docs, queries.BYTE_BPE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, queries.BYTE_BPE).collect()} == texts
    digests = {r.doc_id: r for r in bpe.round_trip(docs, queries.BYTE_BPE).collect()}
    for r in encoded.collect():
        assert digests[r.doc_id].n_tokens == r.n_tokens == len(r.ids)
        assert digests[r.doc_id].ids_sha256 == bpe.sha256(",".join(map(str, r.ids)))
        assert digests[r.doc_id].decoded_sha256 == bpe.sha256(texts[r.doc_id])
    assert bpe.round_trip(docs.limit(0), queries.BYTE_BPE).count() == 0


@needs_data
@needs_vocabulary
def test_op3_equals_the_tokenizer(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in queries.read(spark, SF, "documents").collect()}
    got = queries.op3_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), bpe.sha256(",".join(map(str, ids))))
        assert r.decoded_sha256 == bpe.sha256(tokenizer.decode(ids, skip_special_tokens=False))


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9):
        codes = langid.codewords(n)
        assert len({tuple(c) for c in codes}) == n
        assert all(len(set(bit)) == 2 for bit in codes.T)


@needs_data
def test_language_of_held_out_rows(spark):
    found = queries.op5_language(spark, SF)
    truth = queries.read(spark, SF, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == truth.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in held} == {r.doc_id for r in truth.where(fold(F.col("doc_id"), 4) == 2).collect()}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_sample_counts_copies_once(spark, monkeypatch):
    texts = [f"text number {i}" for i in range(400)]
    rows = [(t, "en") for t in texts] + [(t, "en") for t in texts[:40] for _ in range(100)]
    monkeypatch.setattr(langid, "PER_LANGUAGE", 200)
    labelled = spark.createDataFrame(rows, "text string, lang string")
    got = [r.text for r in langid.drawn_texts(labelled).collect()]
    assert len(got) == len(set(got)) and 150 < len(got) < 250  # of the 400 distinct ones, not of 4 400 rows


def test_language_edge_cases(spark, docs):
    none = langid.train(docs)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.train(spark.createDataFrame([("abc def", "en"), (None, "fr"), ("x", None)], "text string, lang string"))
    found = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, one).collect()}
    assert {d for d, p in found if p == "und"} == {0, 1, 2, 7} and {p for d, p in found if d not in (0, 1, 2, 7)} == {"en"}
    assert langid.identify(docs.limit(0), one).count() == 0


def test_factorization_sees_pairs():
    rng = np.random.default_rng(3)
    a, b = rng.random(1200) < 0.4, rng.random(1200) < 0.4
    y = (a & b).astype(np.int64)
    terms = [np.array(sorted(toxicity.terms_of(" ".join(["insult"] * int(p) + ["group"] * int(q) + [f"w{i % 97}"])))) for i, (p, q) in enumerate(zip(a, b))]
    model = toxicity.fit(terms, y)
    score = [model.score(t) for t in ("insult group", "insult", "group", "", None)]
    assert score[0] > 0.5 and max(score[1:]) < 0.5


def test_toxic_copies_are_near_copies():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 120)) for _ in range(400)]
    texts += [texts[3], texts[5] + " and more", "", None]
    sketches = [np.array(toxicity.sketch_of(t), dtype=np.int64) for t in texts]
    keep = toxicity.without_copies(sketches, np.ones(len(texts), dtype=np.int64))
    assert np.nonzero(~keep)[0].tolist() == [400, 401]
    long = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 3000)) for _ in range(2)]
    a, b, c = (np.array(toxicity.sketch_of(t)) for t in (*long, long[0] + " end"))
    assert toxicity.similarity(a, c) > 0.95 and toxicity.similarity(a, b) < 0.1


def test_terms_are_chosen_by_pairs_too():
    rng = np.random.default_rng(9)
    a, b = rng.random(1000) < 0.5, rng.random(1000) < 0.5
    terms = [np.array(sorted([1] * int(p) + [2] * int(q) + [100 + i % 50])) for i, (p, q) in enumerate(zip(a, b))]
    assert {1, 2} <= set(toxicity.choose_terms(terms, (a == b).astype(np.int64)).tolist())
    rare = [np.array([7] if i < 20 else [100 + i % 50]) for i in range(8000)]
    assert 7 in toxicity.choose_terms(rare, (np.arange(8000) < 2500).astype(np.int64))


@needs_data
def test_toxicity_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    labels = queries.read(spark, sf, "labels")
    rows = queries.op6_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = np.array([(r.toxic, r.predicted) for r in rows])
    assert (hit[hit[:, 0] == 1, 1] == 1).mean() > 0.9 and (hit[hit[:, 0] == 0, 1] == 0).mean() > 0.98


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(4, None), (5, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 8 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>The  title</h1></header><p><b>Bold</b> and&nbsp;plain &amp; &lt;tag&gt;<br><p>Second<!-- no -->&#233; <i>par
agraph</i><ul><li>one<li>two</ul><aside>Also read</aside><form><label>Name</label></form><table><tr><td>1<td>2</table>
<div id="comments"><p>Nice!</p></div></article><aside class="sidebar">Side</aside><footer>&copy; me</footer></body></html>"""


def test_extract_page(spark):
    rows = [Row(page_id=1, url="http://a.example/1", html=PAGE, text="clash"), Row(page_id=1, url=None, html=None, text=None), Row(page_id=None, url="", html="", text="x"),
            Row(page_id=4, url="http://a.example/4", html="no markup <b>at", text=""), Row(page_id=5, url="u", html="<p>un<p class='x", text="")]
    got = extract.extract(spark.createDataFrame(rows)).collect()
    texts = sorted((r.page_id or 0, r.url or "", r._ex_text) for r in got)
    assert texts == sorted([(1, "http://a.example/1", "The title\nBold and plain & <tag>\nSecondé par agraph\none\ntwo\n1\n2"), (1, "", ""), (0, "", ""),
                            (4, "http://a.example/4", "no markup at"), (5, "u", "un")])
    assert extract.extract(spark.createDataFrame(rows).limit(0)).count() == 0


def test_style_trees_drop_what_a_site_repeats(spark):
    frame = "<body><div class=top><p>Welcome to our place</p></div><div class=c><p>Story {0} words {1}</p><p>More {0}</p></div><div><p>All rights</p></div></body>"
    rows = [Row(page_id=i, url=f"https://h.example/{i}", html=frame.format(i, i * 7)) for i in range(20)]
    rows += [Row(page_id=100 + i, url=f"https://few.example/{i}", html=frame.format(i, i)) for i in range(3)]
    got = {r.page_id: r._ex_text for r in extract.extract(spark.createDataFrame(rows)).collect()}
    assert all(got[i] == f"Story {i} words {i * 7}\nMore {i}" for i in range(20))
    assert got[101].startswith("Welcome")  # too few pages to judge


def test_style_trees_judge_plain_prose_of_articles(spark):
    page = "<body><div class=ad>{0}</div><article><h1>Title {1}</h1><p>Story {1}</p><p>Told by all</p><div><p>All rights</p></div></article></body>"
    rows = [Row(page_id=i, url=f"https://h.example/{i}", html=page.format(i, i)) for i in range(20)]
    rows += [Row(page_id=100 + i, url=f"https://copies.example/{i}", html=page.format(i, 7)) for i in range(20)]
    got = {r.page_id: r._ex_text for r in extract.extract(spark.createDataFrame(rows)).collect()}
    assert all(got[i] == f"Title {i}\nStory {i}\nTold by all" for i in range(20))
    assert all(got[100 + i] == "Title 7\nStory 7\nTold by all\nAll rights" for i in range(20))  # one article, copied


@pytest.mark.parametrize("inner,want", [
    ("<h2 id=related-work>Related work</h2><section id=search><h3 id='sharing-data'>Sharing</h3><p class=notice>Note</p></section><ol><li id=tag-3>Third</ol>",
     "Related work\nSharing\nNote\nThird"),
    ("<div id=comments>no</div><section class=related>no</section><ul class=share><li>no</ul><p>yes", "yes"),
    ("<p>a<svg width='1'/>b<p>c<svg><title>no</title></svg>d", "ab\ncd"),
    ("<p>a<svg><p>b<svg><svg>no</svg>no</svg>c", "a\nbc"),
    *[(f"<p>a<{tag}><p>b<{tag}>no</{tag}>c", "a\nbc") for tag in ("noscript", "iframe", "template")],
    ("<p>a<button>no</button> b<p><button>no</button>c", "a b\nc"),
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> so<p>b<math/>c<math>d<p>e", "if x=1 so\nbcd\ne")])
def test_articles_keep_named_text_and_what_follows_open_tags(inner, want):
    page = extract.Page(f"<body><nav>Menu</nav><article>{inner}</article></body>")
    assert "\n".join(text for _, text, _ in extract.left_by_html(page)) == want


@needs_data
def test_pages_keep_their_article(spark):
    import html as entities
    import re

    truth = {r.page_id: r.html for r in queries.read(spark, SF, "pages").collect()}
    rows = queries.op10_text(spark, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        inner = re.search("<article>(.*)</article>", truth[r.page_id], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|br|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_toxicity_counts_repeated_ids_once(spark):
    """Ids that are repeated in both tables change nothing of the model; a repeated id counts with its smallest text."""
    prepare(spark)
    rows = [(i, f"insult group w{i} z{i % 7}" if i % 3 == 0 else f"plain words w{i} y{i % 5}") for i in range(90)]
    marks = [(i, int(i % 3 == 0)) for i in range(90)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    many = docs.unionByName(docs.where("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).select("doc_id", F.concat(F.lit("zz "), "text").alias("text")))
    once = toxicity.train(docs, labels)
    again = toxicity.train(many, labels.unionByName(labels.where("doc_id < 30")))
    assert np.array_equal(once.terms, again.terms) and np.allclose(once.w, again.w) and np.allclose(once.v, again.v)
