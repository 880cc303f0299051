"""The pipeline's stages against plain versions of what each decides, on the smallest tables."""

import os

import pytest
from test_llm_corpus import plain_components, plain_lines

import corpus_pipeline as pipeline
from tarnwatch.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(pipeline.TOKENIZER)), reason="test tables not available")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(table(stage(spark, out[-1], SF), f"test_{name}"))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_keeps_texts(steps):
    lost = steps[0].join(steps[1], "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r.text or "") or len(r.text) < 20 for r in lost)


def test_lines(steps):
    want = {i: text for i, _, _, text in plain_lines([(r.doc_id, r.text) for r in steps[1].collect()])}
    assert {r.doc_id: r.text for r in steps[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_stays(steps):
    groups = plain_components([(r.doc_id, r.text) for r in steps[2].collect()], pipeline.WIDTH, pipeline.PERCENT)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(i for i, _, c in groups if i == c)


def test_mixture_draws(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[3:5])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    share = sum(len(r.text.encode()) for r in after.values()) / sum(len(r.text.encode()) for r in before.values())
    assert 0.75 < share < 1


def test_tokens(steps):
    from tokenizers import Tokenizer

    tokenizer, texts = Tokenizer.from_file(pipeline.TOKENIZER), {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.exact and r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)


def test_run_is_the_stages(spark, steps):
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == sorted(map(str, steps[5].collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, drops string, kept string, n_lines string, n_dropped string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, copies, and columns with names of the operators' own."""
    text = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    clash = ("d", "k", "l", "n", "w")
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t), *clash) for i, t in enumerate(text)]
    rows += [(100 + i, t + " end", None, None, None, *clash) for i, t in enumerate(text[:6])]
    rows += [(None, text[0], "en", "s1", 1, *clash), (None, None, None, None, None, *[None] * 5), (50, "", "en", "s1", 0, *clash), (51, None, "en", "s1", None, *clash)]
    rows += [(7, text[8], "en", "s1", 3, *clash), rows[9], rows[9], (60, " ".join(text) * 30, "en", "s2", 5, *clash), (61, text[3] + "\n" + "one same line over twenty characters\n" * 5, "en", "s2", 5, *clash)]
    rows += [(62 + i, text[20 + i] + "\none same line over twenty characters", "en", "s2", 5, *clash) for i in range(3)]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_bear_odd_tables(spark, odd, name, stage):
    before = sorted(map(str, odd.collect()))
    got = stage(spark, odd, SF)
    rows = got.collect()
    if name == "tokens":
        assert len(rows) == len(before) and all(r.exact and r.n_tokens == len(r.ids) for r in rows)
        assert sum(r.n_tokens == 0 for r in rows) == 3
        return
    assert got.columns == odd.columns and len(rows) <= len(before)
    for r in rows:
        assert (r.drops, r.kept, r.n_lines, r.n_dropped, r.word) in {("d", "k", "l", "n", "w"), (None,) * 5}
    if name != "lines":
        assert not set(map(str, rows)) - set(before)
    if name == "language":
        assert all(r.text for r in rows) and len(rows) > 0.8 * len(before)
    if name == "lines":
        assert len(rows) == len(before) and sum("one same line" in r.text for r in rows) == 1
    if name == "near_copies":
        groups = plain_components([(r.doc_id, r.text) for r in odd.collect()], pipeline.WIDTH, pipeline.PERCENT)
        kept = {i for i, _, c in groups if i is None or i == c} - {i for i, _, c in groups if i is not None and i != c}
        assert {r.doc_id for r in rows} == kept


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_bear_empty_tables(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0
