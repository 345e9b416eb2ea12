"""Scores of texts against models that do not hold them."""

import random
from collections import Counter
from math import log2
from statistics import median

import pytest

from rulegauge.llm import lm
from rulegauge.llm.queries import table

MIX, FLOOR = 0.7, 0.5


def recounted(rows, good, at):
    """Target and background loss of row ``at`` by models counted anew over all other rows; all words are told apart."""
    texts = [(i, [" ", *(t or "").split()]) for i, t in rows]
    kinds = len({w for _, ws in texts for w in ws[1:]}) + 5
    pairs = {kind: Counter() for kind in (True, False)}
    for n, (i, words) in enumerate(texts):
        if n != at:
            for kind in (True, False) if i in good else (False,):
                pairs[kind].update(zip(words, words[1:]))
    even = min(sum(p.values()) for p in pairs.values()) or 1
    words, losses = texts[at][1], []
    for kind in (True, False):
        total = sum(pairs[kind].values())
        scale = even / max(1, total)
        before, after = Counter(), Counter()
        for (a, b), n in pairs[kind].items():
            before[a] += n
            after[b] += n
        loss = 0.0
        for a, b in zip(words, words[1:]):
            single = (after[b] * scale + FLOOR) / (total * scale + FLOOR * kinds)
            loss -= log2(MIX * pairs[kind][a, b] / before[a] + (1 - MIX) * single if before[a] else single)
        losses.append(loss / (len(words) - 1))
    return losses


@pytest.mark.parametrize("good", [{1, 2, 3, 9}, {1}, set()])
def test_left_out_by_recount(spark, monkeypatch, good):
    monkeypatch.setattr(lm, "_SLICE", 300)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c d e f g h É zz".split()) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "only here twice only here"), (9, rows[9][1]), (None, rows[3][1]), (53, "a " * 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in good] + [(1, 1), (30, 0), (None, 1)], "doc_id bigint, quality int").filter(
        "true" if good else "quality = 0")
    got = lm.scored(df, lm.train(df, labels, mix=MIX, floor=FLOOR), leave_out=True).collect()
    want = sorted((str(i), None if not (t or "").split() else tuple(round(x, 6) for x in recounted(rows, good, n))) for n, (i, t) in enumerate(rows))
    assert sorted((str(r.doc_id), None if r.score is None else (round(r.target_loss, 6), round(r.background_loss, 6))) for r in got) == want
    assert all(r.score is None or abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in got)


def test_other_frames_have_nothing_to_leave_out(spark):
    df = spark.createDataFrame([(i, f"a b c{i}") for i in range(9)], "doc_id bigint, text string")
    models = lm.train(df, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    new = df.filter("doc_id < 4")
    plain = {r.doc_id: r.score for r in lm.scored(new, models).collect()}
    assert plain == {r.doc_id: r.score for r in lm.scored(new, models, leave_out=True).collect()}
    assert lm.scored(df.limit(0), models, leave_out=True).count() == 0


def test_scores_do_not_tell_the_training_sample(spark):
    """Half of the good labels are held out: good texts in the sample and out of it score alike, bad ones above both."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    shown = labels.filter("quality = 1 AND doc_id % 2 = 0")
    models = lm.train(docs, shown)
    quality = {r.doc_id: r.quality for r in labels.collect()}

    def middles(leave_out):
        scores = {"in": [], "out": [], "bad": []}
        for r in lm.scored(docs, models, leave_out=leave_out).collect():
            if r.doc_id in quality and r.score is not None:
                scores["bad" if not quality[r.doc_id] else "out" if r.doc_id % 2 else "in"].append(r.score)
        return {k: median(v) for k, v in scores.items()}
    before, after = middles(False), middles(True)
    print(before, after)
    assert abs(after["in"] - after["out"]) < 0.2 * abs(before["in"] - before["out"])
    assert after["bad"] > max(after["in"], after["out"])
