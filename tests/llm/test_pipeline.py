"""The pipeline's stages against brute force on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
import corpus_pipeline

from rulegauge.llm import pii, quality, simhash
from rulegauge.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "stage"))
    return out


def rows(df):
    return sorted(df.select("doc_id", "text", "source").collect())


def test_columns_are_those_of_documents(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    assert stages[5].columns == [*stages[0].columns, "copy"]


def test_quality_stage(stages):
    kept = {r.doc_id for r in quality.report(stages[0]).filter("kept").collect()}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r.doc_id in kept]
    for r in rows(stages[0]):
        n, _, _, _, repeated = brute.base_counts(r.text)
        assert not (r.doc_id in kept and (n < 50 or 100 * repeated > 50 * n))


def test_duplicates_stage(stages):
    kept = brute.one_of_near_copies([(r.doc_id, r.text) for r in rows(stages[1])])
    assert [r.doc_id for r in rows(stages[2])] == kept


def test_near_copies_of_all_kinds(spark):
    words = [f"word{i * i % 977}" for i in range(400)]

    def without(k, every):
        return " ".join(w for i, w in enumerate(words) if i % every != k or i < 20)
    texts = [" ".join(words), " ".join(words).upper(), "  ".join(words) + "\n", without(3, 50), without(7, 60), without(3, 5),
             " ".join(words[:200]), None, "", " \t", "one two", "one  two", "one three", "word " * 30_000, "word " * 29_000, "unlike all others here"]
    shape = "_row string, doc_id bigint, text string, root string, node int"
    df = spark.createDataFrame([("x", i, t, "r", 0) for i, t in enumerate(texts)] + [("x", 3, texts[3], "r", 0), ("x", None, texts[15], "r", 1)], shape)
    got = simhash.keep_one_similar(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == brute.one_of_near_copies(list(enumerate(texts))) == [0, 5, 6, 7, 10, 12, 13, 15]
    assert simhash.keep_one_similar(df.limit(0)).count() == 0


def test_chains_of_near_copies(spark):
    """Each text is near the one before only: the group is one, however long."""
    words = [f"w{i}" for i in range(600)]
    df = spark.createDataFrame([(100 - k, " ".join(words[4 * k:4 * k + 200])) for k in range(60)], "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.keep_one_similar(df).collect()] == [41]


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute.contamination([(r.doc_id, r.text) for r in rows(stages[2])], items)
    assert [r.doc_id for r in rows(stages[3])] == sorted(j[0] for j in judged if not j[5])


def test_pseudonym_stage(stages):
    assert rows(pii.restored(stages[4])) == rows(stages[3])
    assert rows(stages[4]) != rows(stages[3])


def test_mixture_stage(stages):
    sizes = {}
    for r in rows(stages[4]):
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    taken, texts = {}, dict((r.doc_id, r.text) for r in rows(stages[4]))
    for r in rows(stages[5]):
        assert texts[r.doc_id] == r.text
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    largest = {s: max(len(brute.words(r.text)) for r in rows(stages[4]) if r.source == s) for s in sizes}
    for s, target in brute.mixture_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= largest[s] + 1


def test_run_is_the_stages(spark, stages):
    key = ["doc_id", "copy"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select(*key).collect()) == sorted(stages[5].select(*key).collect())
