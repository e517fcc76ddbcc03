"""The corpus pipeline: stages keep the columns and what they decide takes effect."""

import pytest

import corpus_pipeline
from medialake.llm.queries import ORACLE, QUERIES


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_small).cache()
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_small)
    assert last.count() == sizes[-1]
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, sf_small).collect()}


def test_near_duplicates_from_four_fifths(spark):
    words = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{k}" for k in range(10))])), (3, " ".join([*words[:84], *(f"y{k}" for k in range(20))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # similarities of 90/110 with 1 and of 80/120 beyond
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


def _odd(spark, sf_small):
    """Documents with null and repeated ids, null, empty and long texts, ties, and columns that operators use names of."""
    some = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [tuple(r) for r in some]
    text = some[0].text
    rows += [(None, text, "en", "s", 1), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \t\n", "en", "s", 3), (9004, "word " * 40_000, "en", "s", 200_000), rows[1], rows[1], (9005, rows[1][1], "en", "s", 1), (9006, rows[1][1], "en", "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, toxic int, score double, item_id long, component_id long, kept boolean, __text string, y int"
    return spark.createDataFrame([(*r, 1, 0.5, 2, 3, True, "clash", 4) for r in rows], names)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_small, stage):
    """No stage stumbles over odd rows or names; all but the last keep the columns, and an empty table stays empty."""
    docs = _odd(spark, sf_small).repartition(3)
    function = dict(corpus_pipeline.STAGES)[stage]
    out = function(spark, docs, sf_small)
    got = out.collect()
    ids = [r.doc_id for r in got]
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and {r["__text"] for r in got} == {"clash"}
        assert {9001, 9002, 9003} <= set(ids) and None in ids
    else:
        assert len(got) == docs.count()
    if stage == "near_duplicates":
        assert 9005 not in ids and 9006 not in ids and ids.count(1) == 3
    assert function(spark, docs.limit(0), sf_small).count() == 0
