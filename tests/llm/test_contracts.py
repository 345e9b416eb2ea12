"""The operators against SQL on the smallest scale and against brute force on awkward inputs."""

import os
import random
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
import check

from rulegauge.llm import decontamination, lm, mixing, pii, quality, simhash, suffix_array, suffix_tree, token_counts, warc
from rulegauge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns with the names that operators use inside or return
CLASHES = ("size", "_row", "taken", "copies", "copy", "component_id", "kept", "spans", "anchors", "tree", "score", "_doc",
           "place", "anchor", "_print", "fingerprint", "n_words", "texts", "_found", "target", "value", "key", "block")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in check.TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    said, _, fine = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert fine, said


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def some_text(rng, n):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz the of and é ñandú".split()) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    base = some_text(rng, 120)
    passage = some_text(rng, 70)
    texts = [None, "", " \n\t ", "one", "The", base, base, base.replace("the", "thy", 1), base + " tail", passage,
             some_text(rng, 30) + " " + passage + " " + some_text(rng, 30), some_text(rng, 25) + "  " + passage, "of " * 300, "of " * 250,
             "x" * 5000, "x" * 450, some_text(rng, 9000), base.upper(), "line one\nline one\n\nline two " * 20,
             passage + " " + passage, "ab cd " * 40, base, some_text(rng, 60).replace(" ", "\n")]
    texts += [some_text(rng, rng.randint(1, 90)) for _ in range(20)]
    rows = [(i, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["b", "a", None, "é", "zz"]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[10], (None, base, None, None, None), (None, None, None, None, None), (7, passage, "en", "a", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in row)


def same(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


def test_simhash(docs, rows, nothing):
    got = simhash.simhash_components(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    same(got, brute.components([r[:2] for r in rows]))
    assert simhash.simhash_components(nothing).count() == 0


def test_simhash_keeps_one_of_each_group(docs, rows, nothing):
    least = {}
    for r, root in zip(rows, brute.groups([brute.simhash(r[1]) for r in rows])):
        least[root] = min(least.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    kept = [r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(x for _, x in least.values())
    assert simhash.keep_one(docs).columns == [c for c in docs.columns if c != "_row"]
    assert simhash.keep_one(nothing).columns == nothing.columns and simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("near", [0, 1, 2, 4, 6])
def test_trie_finds_every_link(spark, near):
    rng = random.Random(near)
    prints = []
    for _ in range(40):
        center = rng.getrandbits(64)
        prints.append(center)
        for _ in range(8):
            flipped = center
            for bit in rng.sample(range(64), rng.randint(1, near + 2)):
                flipped ^= 1 << bit
            prints.append(flipped)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in set(prints))
    df = spark.createDataFrame([(p,) for p in signed], "_print bigint")
    got = {r["_print"]: r.root for r in simhash.classes(df, budget=near, depth=3).collect()}
    assert got == {p: signed[i] for p, i in zip(signed, brute.groups(signed, near))}


@pytest.mark.parametrize("limit", [20_000, 1])
def test_words_removed(docs, rows, limit):
    got = suffix_tree.removed(docs, limit=limit)
    same(got.drop("kept"), brute.without_repeated_words([r[:2] for r in rows]))


@pytest.mark.parametrize("limit", [20_000, 1])
def test_bytes_removed(docs, rows, limit):
    got = suffix_array.removed(docs, limit=limit)
    same(got.drop("kept"), brute.without_repeated_bytes([r[:2] for r in rows]))


def test_repeats_in_many_small_texts(spark):
    rng = random.Random(8)
    pieces = [some_text(rng, 18) for _ in range(12)]
    texts = [(i, " ".join(rng.choice(pieces) if rng.random() < 0.6 else some_text(rng, 5) for _ in range(6))) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    same(suffix_tree.removed(df).drop("kept"), brute.without_repeated_words(texts))
    same(suffix_array.removed(df, width=60, gram=30).drop("kept"), brute.without_repeated_bytes(texts, 60))


def test_repeats_of_an_empty_table(nothing):
    assert suffix_tree.removed(nothing).count() == 0 and suffix_array.removed(nothing).count() == 0


def test_kept_text_is_what_the_digest_says(docs):
    got = suffix_tree.removed(docs).withColumn("again", F.sha2("kept", 256))
    assert got.filter("again != kept_sha256").count() == 0
    got = suffix_array.removed(docs).withColumn("again", F.sha2("kept", 256))
    assert got.filter("again != kept_sha256 or octet_length(kept) != n_bytes - n_removed").count() == 0


ITEMS = "item_id bigint, text string, size string, _row bigint"


def test_decontamination(spark, docs, rows, nothing):
    passage = rows[9][1]
    items = [(1, passage), (2, " ".join(passage.split()[10:40])), (3, "zz yy xx"), (4, None), (5, ""), (30, "Uv, wx! yz"), (None, passage[:90]), (1, passage)]
    bench = spark.createDataFrame([(*x, "c", 1) for x in items], ITEMS)
    want = brute.contamination([r[:2] for r in rows], items)
    same(decontamination.report(docs, bench), want)
    bad = sorted(w[0] for w in want if w[5] and w[0] is not None)
    left = [r.doc_id for r in decontamination.keep_clean(docs, bench).collect()]
    assert len(left) == sum(not w[5] for w in want) and not set(left) & set(bad) - {w[0] for w in want if not w[5]}
    assert decontamination.report(docs, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert decontamination.report(nothing, bench).count() == 0


def test_decontamination_in_blocks(spark, docs, rows):
    items = [(i, rows[9][1]) for i in range(5)] + [(9, "uv wx yz")]
    bench = spark.createDataFrame([(*x, "c", 1) for x in items], ITEMS)
    rows_ = decontamination.numbered(docs.select("doc_id", "text"))
    counts, hits = decontamination.found(rows_, bench, block_words=20)
    assert counts.count() == len(rows)
    assert hits.select("item_id").distinct().count() == 6


def test_proximity(spark):
    docs_ = spark.createDataFrame([(1, "a b c x d e f"), (2, "a b c d e f"), (3, "f e d c b a"), (4, "a q b c d e f")], "_row bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    _, exact = decontamination.found(docs_, bench)
    assert {r["_row"] for r in exact.collect()} == {2}
    _, near = decontamination.found(docs_, bench, slop=1)
    got = {(r["_row"], r.exact) for r in near.collect()}
    assert {x for x, _ in got} == {1, 2, 4} and (2, True) in got and (1, True) not in got


def test_mixture(docs, rows, nothing):
    report = mixing.mix_report(docs).collect()
    sizes, taken, largest = {}, {}, {}
    by_source = {}
    for r in rows:
        n = len(brute.words(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        largest[r[3]] = max(largest.get(r[3], 0), n)
        by_source.setdefault((r[0], n), set()).add(r[3])
    targets = brute.mixture_targets(sizes)
    assert len(report) == len(rows)
    for r in report:
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        source = next(s for s in by_source[(r.doc_id, r["size"])] if sizes[s] == r.source_size)
        assert r.target == targets[source]
        taken[source] = taken.get(source, 0) + r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] + 1
    assert sorted(map(key, mixing.mix_report(docs.repartition(9)).collect())) == sorted(map(key, report))
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixture_repeats_documents(docs):
    mixed = mixing.mix(docs)
    assert mixed.count() == mixing.mix_report(docs).agg(F.sum("copies")).first()[0]
    assert mixed.columns == [c for c in docs.columns if c not in ("_row", "copy")] + ["copy"]


def test_quality_counts(docs, rows, nothing):
    got = quality.report(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counts = [(r[0], *brute.base_counts(r[1])) for r in rows]
    same(got.select(*names), [(*c, c[1] < 50 or 100 * c[5] > 50 * c[1]) for c in counts])
    assert got.filter("kept and base_failed").count() == 0 and quality.report(nothing).count() == 0
    assert quality.keep_good(nothing).columns == nothing.columns


def test_quality_distance_by_hand(spark):
    rng = random.Random(1)
    plain = [(i, "The " + " ".join(rng.choice("the of and to house garden river stone".split()) + str(rng.choice("ab")) * rng.randint(0, 2)
                                   for _ in range(150)), "en") for i in range(40)]
    junk = [(100, " ".join(f"{rng.getrandbits(20):x}***" for _ in range(150)), "en")]
    got = {r.doc_id: r for r in quality.report(spark.createDataFrame(plain + junk, "doc_id bigint, text string, lang string")).collect()}
    assert not got[100].kept and sum(got[i].kept for i in range(40)) >= 38
    import numpy as np
    profiles = [quality.measured(t.encode(), "en") for _, t, _ in plain + junk]
    good = [p for p, r in zip(profiles, plain + junk) if not got[r[0]].base_failed]
    for i, name in ((5, "class_distance"), (6, "word_distance")):
        ref = sum(np.floor(p[i] * 1_000_000 / p[i].sum()) for p in good)
        for p, r in zip(profiles, plain + junk):
            a, b = p[i] / p[i].sum(), ref / ref.sum()
            m = (a + b) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                js = (np.nansum(a * np.log2(a / m)) + np.nansum(b * np.log2(b / m))) / 2
            assert abs(getattr(got[r[0]], name) - np.sqrt(js)) < 1e-6


def test_quality_drops_labelled_junk(spark):
    """Of labelled texts that pass the base rules nearly all junk goes and nearly all good texts stay."""
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality")
    judged = quality.report(spark.read.parquet(f"{at}/documents.parquet")).join(labels, "doc_id").filter("not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got.get((0, True), 0) <= 0.15 * (got.get((0, True), 0) + got[0, False])
    assert got.get((1, False), 0) <= 0.005 * got[1, True]


PII = [(1, "card 4111111111111111 and 4111 1111 1111 1111, bad 4111111111111112"), (2, "+1 (017) 555-7713 (415) 555-0199 415-555-0199."),
       (3, "192.168.1.10, 999.1.1.1 and 10.0.0.1."), (4, "1984-02-29, 02/30/2001 02/28/2001 31.12.1999 2024-12-01"), (5, "123-45-6789 000-12-3456"),
       (6, "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE88370400440532013000"), (7, "Bob.S42@example.com, bob.s42@example.com!! a@b.co"),
       (8, ""), (9, None), (None, "4451718024887799 27.65.93.188"), (10, "no 12 values"), (10, "no 12 values"), (11, "word " * 40_000 + "7.8.9.10")]


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms(spark, docs, nothing):
    df = spark.createDataFrame(PII, "doc_id bigint, text string").withColumn("size", F.lit(1)).withColumn("_hits", F.lit(2))
    found = {r.doc_id: r for r in pii.replaced(df.drop("_hits"), key="k").collect()}
    cards = [h.pseudonym for h in found[1]._found]
    assert len(cards) == 2 and cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) and cards[0][0] == "4"
    assert "4111111111111112" in found[1].text and "4111111111111111" not in found[1].text
    phones = [h.pseudonym for h in found[2]._found]
    assert phones[1][1:4] + phones[1][6:] == phones[2].replace("-", "", 1)[0:3] + phones[2][4:] and phones[0].startswith("+1 (")
    assert [h.value for h in found[3]._found] == ["192.168.1.10", "10.0.0.1"]
    assert all(0 <= int(o) < 256 for h in found[3]._found for o in h.pseudonym.split("."))
    assert [h.value for h in found[4]._found] == ["1984-02-29", "02/28/2001", "31.12.1999", "2024-12-01"]
    assert found[4]._found[0].pseudonym[:2] == "19" and found[4]._found[3].pseudonym[:2] == "20"
    assert [h.value for h in found[5]._found] == ["123-45-6789"]
    for h in found[6]._found:
        plain = h.pseudonym.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert len(found[6]._found) == 2
    mails = [h.pseudonym for h in found[7]._found]
    assert mails[0].lower() == mails[1] and mails[0] != mails[1] and mails[0].endswith("@example.com")
    assert found[8].text == "" and found[9].text is None and found[10].text == "no 12 values"
    assert pii.pseudonymized(df).columns == ["doc_id", "text", "size"]
    assert pii.report(nothing).count() == 0 and pii.report(docs).count() == docs.count()


def test_pseudonyms_are_a_permutation_with_a_way_back(spark):
    df = spark.createDataFrame(PII, "doc_id bigint, text string")
    same(pii.restored(pii.pseudonymized(df, key="k"), key="k"), PII)
    days = spark.range(0, 36524).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    new = pii.pseudonymized(days)
    assert new.select("text").distinct().count() == 36524
    assert new.filter("text not between '1900-01-01' and '1999-12-31'").count() == 0
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    back = pii.restored(pii.pseudonymized(whole)).withColumnRenamed("text", "back")
    assert whole.join(back, "doc_id").filter("text != back").count() == 0


def test_pseudonyms_stay_in_the_jvm(spark):
    plan = QUERIES["op1_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PAGES = "page_id bigint, url string, html string, value string, file string"


def test_archives_survive_magic_inside_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows_ = [(1, "http://a/1\r\nContent-Length: 7", "<p>x</p>"), (2, None, None), (3, "http://a/3", ""), (4, "u", fake + "WARC/1.1\r\n" * 50),
             (5, "u", "<p>x</p>"), (9, "u", "é" * 30_000 + fake), (7, "u", "<p>x</p>"), (7, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "lone"),
             (8, "u", "\r\n\r\n"), (12, "u", "y" * 200_000), (13, "u", fake * 400)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (before, "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            path = tempfile.mkdtemp(prefix="warc-") + "/a"
            warc.write(spark.createDataFrame([(*r, "c", "c") for r in rows_], PAGES).repartition(2), path)
            for small in (200_000, 0):
                got = warc.read(spark, path, small=small).collect()
                want = sorted(((p, h or "") for p, _, h in rows_), key=key)
                payload = {}
                for r in got:
                    if r.record_type == "response":
                        payload[r.payload_digest] = bytes(r.payload).decode()
                assert sorted(((r.page_id, payload[r.payload_digest]) for r in got), key=key) == want
                assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 7), (5, 7), (None, 7), (2, 3)}
                assert all(r.payload_bytes == len(payload[r.payload_digest].encode()) for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("small", [200_000, 0])
def test_archives_are_cut_alike_in_both_scans(spark, small):
    """Between the scans the parallelism changes, as when executors are lost."""
    path = tempfile.mkdtemp(prefix="warc-") + "/a"
    warc.write(spark.createDataFrame([(i, "u", f"page {i} " * 200, "", "") for i in range(400)], PAGES).coalesce(1), path)
    keys = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    spark.conf.set(keys[0], "0")
    spark.conf.set(keys[1], "3")
    try:
        got = warc.read(spark, path, small=small)
        spark.conf.set(keys[1], "7")
        assert sorted(r.page_id for r in got.select("page_id").collect()) == list(range(400))
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_archive_of_nothing_and_torn_archive(spark):
    path = tempfile.mkdtemp(prefix="warc-") + "/a"
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0
    path = tempfile.mkdtemp(prefix="warc-") + "/b"
    warc.write(spark.createDataFrame([(1, "u", "first", "", ""), (2, "u", "second" * 50, "", "")], PAGES).coalesce(1), path)
    name = next(f for f in os.listdir(path) if f.startswith("part"))
    with open(f"{path}/{name}", "r+b") as f:
        f.truncate(os.path.getsize(f"{path}/{name}") - 100)
    if os.path.exists(f"{path}/.{name}.crc"):
        os.remove(f"{path}/.{name}.crc")
    assert [r.page_id for r in warc.read(spark, path).collect()] == [1]


def test_language_models(spark, docs, nothing):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice("red green blue".split()) for _ in range(80)), "", "", 1) for i in range(30)]
    bad = [(100 + i, " ".join(rng.choice("x1 *** ZZ blue".split()) for _ in range(80)), "", "", 1) for i in range(30)]
    df = spark.createDataFrame(good + bad + [(500, None, "", "", 0), (None, "red blue", "", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(110, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    models = lm.train(df, labels, size=8, mix=0.6, floor=0.5)
    got = {r.doc_id: r for r in lm.scored(df, models).collect()}
    assert max(got[i].score for i in range(30)) < min(got[100 + i].score for i in range(30))
    assert got[500].n_tokens == 0 and got[500].score is None
    # the same model from its definition
    from collections import Counter
    from math import log2
    words = [w for w, _ in sorted(Counter(w for r in good + bad + [(0, "red blue")] for w in r[1].split()).items(), key=lambda x: (-x[1], x[0]))][:8]
    ids = {w: i + 5 for i, w in enumerate(words)}
    pairs = {True: Counter(), False: Counter()}
    for r in good + bad + [(None, "red blue")]:
        codes = [0, *[ids[w] for w in r[1].split()]]
        for kind in ((True, False) if r[0] is not None and r[0] < 20 else (False,)):
            pairs[kind].update(zip(codes, codes[1:]))
    even = min(sum(p.values()) for p in pairs.values())
    losses = []
    for kind in (True, False):
        scale = even / sum(pairs[kind].values())
        first, second = Counter(), Counter()
        for (a, b), n in pairs[kind].items():
            first[a] += n * scale
            second[b] += n * scale
        total = even + 0.5 * (len(words) + 5)
        codes = [0, *[ids[w] for w in bad[0][1].split()]]
        loss = 0.0
        for a, b in zip(codes, codes[1:]):
            single = (second[b] + 0.5) / total
            loss -= log2(0.6 * pairs[kind][a, b] * scale / first[a] + 0.4 * single if first[a] else single)
        losses.append(loss / (len(codes) - 1))
    assert abs(got[100].target_loss - losses[0]) < 1e-4 and abs(got[100].background_loss - losses[1]) < 1e-4
    assert lm.scored(docs, models).count() == docs.count() and lm.scored(nothing, models).count() == 0
    flat = lm.train(nothing, labels.limit(0), size=4)
    assert lm.scored(df, flat).filter("abs(score) > 1e-6").count() == 0


def test_language_models_tell_rare_words_apart(spark):
    """2,000 words, each seen 20 times and good texts made of one half: a model of the most frequent words cannot tell."""
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    halves = []
    for half in (words[:1000], words[1000:]):
        bag = half * 20
        rng.shuffle(bag)
        halves.append([" ".join(bag[i:i + 50]) for i in range(0, len(bag), 50)])
    common = " ".join(f"c{i}" for i in range(1100))
    rows_ = [(i, t) for i, t in enumerate(halves[0] + halves[1])] + [(9000 + i, common) for i in range(30)]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id bigint, quality int")
    models = lm.train(df, labels)
    assert models.kinds == 2000 + 1100 + 5
    got = {r.doc_id: r.score for r in lm.scored(df, models).collect()}
    assert max(got[i] for i in range(400)) < min(got[i] for i in range(400, 800))
    # a frame the models were not made of has the same scores, and one with words never seen has finite ones
    other = {r.doc_id: r.score for r in lm.scored(df.filter("doc_id < 500"), models).collect()}
    assert len(other) == 500 and all(abs(other[i] - got[i]) < 1e-9 for i in other)
    new = lm.scored(spark.createDataFrame([(1, "never seen waaa never")], "doc_id bigint, text string"), models).first()
    assert new.n_tokens == 4 and new.background_loss > 0


def test_token_counts_follow_edits(spark, docs, nothing):
    count = token_counts.encoder(token_counts.TOKENIZER, token_counts.PATTERN)
    rng = random.Random(4)
    texts = [None, "", " ", "a b", "x" * 3000, "don't we'll " * 300, "é ñ 12 34!! " * 200, " \n \n" * 300, some_text(rng, 5000)]
    rows_, want = [], {}
    for i, text in enumerate(texts * 4):
        edits, now = [], text or ""
        for _ in range(6):
            at, gone = rng.randint(-2, len(now) + 3), rng.choice([0, 1, 5, 400])
            new = rng.choice(["", " ", "  ", "the cat", "\n", "'s", "a" * 700, " word" * 200, None])
            edits.append((at, gone, new))
            at = min(max(at, 0), len(now))
            now = now[:at] + (new or "") + now[at + gone:]
        rows_.append((i, text, edits))
        want[i] = (count(text or ""), count(now), len(now))
    df = spark.createDataFrame(rows_, "doc_id bigint, text string, edits array<struct<at int, remove int, insert string>>")
    got = token_counts.recounted(token_counts.with_trees(df)).collect()
    assert {r.doc_id: (r.counts.before, r.counts.after, r.counts.length) for r in got} == want
    one = spark.createDataFrame([(1, texts[-1], [(2000, 3, "cat")])], "doc_id bigint, text string, edits array<struct<at int, remove int, insert string>>")
    assert token_counts.recounted(token_counts.with_trees(one)).first().counts.encoded < 3 * token_counts.LEAF
    none = docs.withColumn("edits", F.lit(None).cast("array<struct<at:int,remove:int,insert:string>>"))
    same_ = token_counts.recounted(token_counts.with_trees(none))
    assert same_.filter("counts.before != counts.after or counts.encoded != 0").count() == 0 and same_.count() == docs.count()
    assert token_counts.recounted(token_counts.with_trees(nothing.withColumn("edits", F.lit(None).cast("array<struct<at:int,remove:int,insert:string>>")))).count() == 0
