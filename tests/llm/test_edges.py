"""Nulls, blanks, very long texts, repeats, empty tables and clashing column names in every operator and stage."""

import pytest

import corpus_pipeline
from strandline.llm import htmltext, language, mixing, packing, pii, quality, rules, simhash, urlrules, winnowing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, row int, block string, votes int, taken string, `mark` int, size double, salt int, place int, `weird name` string"
LONG = "lorem ipsum dolor sit amet 192.168.0.1 " * 40_000


def rows():
    tail = ("i", 1, 2, "b", 3, "t", 4, 5.0, 6, 7, "w")
    base = [(1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, None, None, None), (None, "text without an id", None, "a"),
            (3, "", "en", None), (4, " \t\n", None, "b"), (5, LONG, "la", "b"), (6, LONG, "la", "b"), (7, "12 34 ...", "en", "a"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), *tail) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).cache()


OPERATORS = {
    "simhash": (simhash.near_duplicates, 10),
    "winnowing": (winnowing.compare_edited, 10),
    "mixing": (mixing.mix, 10),
    "rules": (rules.judge, 10),
    "packing": (packing.pack, None),
    "pii": (pii.detect, 10),
    "language": (language.identify, 10),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_anything(docs, name):
    operator, n = OPERATORS[name]
    got = operator(docs).collect()
    assert len(got) == n if n else len({r.doc_id for r in got}) == 8
    assert operator(docs.limit(0)).collect() == []
    nothing = docs.selectExpr("doc_id", *[f"CAST(NULL AS {t}) AS `{c}`" for c, t in docs.dtypes if c != "doc_id"])
    assert len(operator(nothing).collect()) >= 10


def test_quality_takes_anything(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "y"), (5, None, "z")], "doc_id long, quality int, score string")
    assert quality.score(docs, labels).count() == 10
    assert quality.score(docs, labels.limit(0)).count() == 10


def test_pages_take_anything(spark):
    rows_ = [(1, None, None, 1, "x"), (None, "http://a.com/x", "<p>" * 5000 + "deep", 1, "x"), (1, "u", "<article>" + "<p>word</p>" * 20_000, 1, "x"), (1, "u", "<article>" + "<p>word</p>" * 20_000, 1, "x")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, text int, host string")
    got = htmltext.extract(pages).collect()
    assert len(got) == 4 and max(r.n_chars for r in got) == 20_000 * 6 - 2
    judged = urlrules.judge(pages, pages.selectExpr("url", "CAST(NULL AS boolean) AS bad"))
    assert judged.count() == 4 and judged.columns == ["page_id", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_takes_anything(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, "")
    if stage != "packed":
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
    got.collect()
    assert run(spark, docs.limit(0), "").collect() == []
