"""What the near-duplicate stage moves and leaves behind: candidates, asked texts, written tables."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from rulegauge.llm import simhash
from rulegauge.session import shared_dir


def _texts(n: int) -> list[str]:
    words = [f"w{i}" for i in range(200)]
    # copies with some words changed: all alike, few of them at 0.8
    return [" ".join(f"x{k}" if (i * 7 + k) % 29 == 0 and i % 5 else w for i, w in enumerate(words)) for k in range(n)]


def test_candidates_that_signatures_rule_out_stay_in_their_task(spark):
    rows = [(k, t.encode()) for k, t in enumerate(_texts(40))]
    bits = [simhash.signature(simhash.shingles(t)[1]) for _, t in rows]
    signed = spark.createDataFrame([(k, [int(x) for x in b.view(np.int64)]) for (k, _), b in zip(rows, bits)],
                                   "_row bigint, _bits array<bigint>").cache()

    def apart(a, b):
        return int(np.bitwise_count(bits[a] ^ bits[b]).sum())
    every = {(r.a, r.b): r.differ for r in simhash._candidates(signed, 0, 640, range(20)).collect()}
    assert every and all(d == apart(a, b) for (a, b), d in every.items())
    most = sorted(every.values())[len(every) // 2]
    some = {(r.a, r.b): r.differ for r in simhash._candidates(signed, 0, most, range(20)).collect()}
    assert some == {pair: d for pair, d in every.items() if d <= most}
    turns = [simhash._candidates(signed, 0, 640, range(t, t + 5)) for t in range(0, 20, 5)]
    assert {(r.a, r.b) for turn in turns for r in turn.collect()} == set(every)


def test_sets_of_asked_texts_are_made_without_a_shuffle_of_texts(spark):
    texts = spark.createDataFrame([*enumerate(_texts(300)), (1 << 40, None)], "_row bigint, text string").repartition(7)
    ends = spark.createDataFrame([(3,), (250,), (1 << 40,)], "_row bigint")
    found = simhash._sets(texts, ends, 5, 42)
    got = {r._row: r._set for r in found.collect()}
    assert {3, 250, 1 << 40} <= set(got) and len(got) < 30 and got[1 << 40] == []
    assert got[3] == simhash.shingles(_texts(4)[3].encode())[1].view(np.int64).tolist()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_nothing_asked_gives_no_sets(spark):
    texts = spark.createDataFrame(enumerate(_texts(3)), "_row bigint, text string")
    assert simhash._sets(texts, texts.select("_row").filter(F.lit(False)), 5, 42).count() == 0


def test_only_what_the_result_reads_stays_written(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(_texts(12) * 2)], "doc_id bigint, text string")
    kept = simhash.keep_one_similar(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before}
    # tables of the rounds of components are small and stay
    assert left <= {"docs", "kept", "edges", "least", "large", "low"}, left
    assert kept.count() <= 12
