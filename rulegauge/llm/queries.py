"""Queries of the training-text operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.session import apply_defaults, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 3: mixing ---------------------------------------------------------------------------------------

MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT 0 AS round, (SELECT SUM(source_size)::BIGINT FROM w) AS rest, (SELECT SUM(weight)::BIGINT FROM w) AS shares
  UNION ALL
  SELECT round + 1, (SELECT SUM(source_size)::BIGINT FROM w) - COALESCE((SELECT SUM(cap)::BIGINT FROM w
           WHERE weight * rest > cap * shares), 0),
         (SELECT SUM(weight)::BIGINT FROM w WHERE NOT weight * rest > cap * shares)
  FROM r WHERE round < 25),
f AS (SELECT rest, shares FROM r ORDER BY round DESC LIMIT 1),
t AS (
  SELECT w.*, CASE WHEN weight * rest > cap * shares THEN cap::DOUBLE
                   ELSE rest::DOUBLE * weight::DOUBLE / shares::DOUBLE END AS target
  FROM w, f),
u AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS DECIMAL(20,12)) AS expected,
         CAST(('0x' || substr(sha256('mix|' || place), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS DECIMAL(20,12)) AS off
  FROM t),
x AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.expected,
         u.off + COALESCE(SUM(u.expected) OVER (PARTITION BY u.place ORDER BY d.size, d.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (floor(start + expected) - floor(start))::BIGINT * size AS taken,
       (floor(start + expected) - floor(start))::BIGINT AS copies FROM x"""


@query("op3_mix", MIX_SQL)
def op3_mix(spark, sf_dir):
    from rulegauge.llm.mixing import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


# ---- 2: archives -------------------------------------------------------------------------------------

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS h, sha1(COALESCE(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '')
           AS payload_digest
  FROM p),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM m"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark, sf_dir):
    from rulegauge.llm import warc
    path = work_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---- 5: near-duplicates ------------------------------------------------------------------------------

@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    from rulegauge.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


# ---- 6: decontamination ------------------------------------------------------------------------------

CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS win, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n.n, unnest(range(1, len(w) - n.n + 2)) AS i FROM d, n WHERE len(w) >= n.n)),
m AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.win = v.win),
h AS (SELECT doc_id, COUNT(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, COUNT(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(h.n_hit, 0)::BIGINT AS n_hit,
       COALESCE(t.n_items, 0)::BIGINT AS n_items, COALESCE(t.items_sha256, sha256('')) AS items_sha256,
       COALESCE(h.n_hit, 0) > 0 AND 20 * COALESCE(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op6_decontaminate", CONTAMINATION_SQL)
def op6_decontaminate(spark, sf_dir):
    from rulegauge.llm import decontamination
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- 4: quality rules --------------------------------------------------------------------------------

@query("op4_quality")
def op4_quality(spark, sf_dir):
    from rulegauge.llm import quality
    return quality.report(table(spark, sf_dir, "documents"))


# ---- 1: personal data --------------------------------------------------------------------------------

@query("op1_pii")
def op1_pii(spark, sf_dir):
    from rulegauge.llm import pii
    return pii.report(table(spark, sf_dir, "documents"))


# ---- 9: substring removal by words -------------------------------------------------------------------

WORDS_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT md5(array_to_string(win, ' ')) AS h, doc_id, i FROM p),
f AS (SELECT h, MIN(doc_id) AS least FROM m GROUP BY h),
g AS (SELECT DISTINCT m.doc_id, unnest(range(m.i, m.i + 13)) AS x FROM m JOIN f USING (h) WHERE m.doc_id > f.least),
r AS (SELECT doc_id, list(x) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, COALESCE(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '))
         AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""


@query("op9_suffix_tree", WORDS_SQL)
def op9_suffix_tree(spark, sf_dir):
    from rulegauge.llm import suffix_tree
    return suffix_tree.removed(table(spark, sf_dir, "documents"), texts=False)


# ---- 10: substring removal by bytes ------------------------------------------------------------------

BYTES_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(COALESCE(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400),
m AS (SELECT doc_id, i, md5(substr(x, (2 * i + 1)::BIGINT, 400)) AS h FROM p),
f AS (SELECT h FROM m GROUP BY h HAVING COUNT(*) > 1),
k AS (SELECT doc_id, i FROM m WHERE h IN (SELECT h FROM f)),
o AS (SELECT *, MAX(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM k),
s AS (SELECT *, SUM(CASE WHEN e IS NULL OR i > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, MIN(i) AS a, MAX(i + 200) AS b FROM s GROUP BY doc_id, run),
l AS (
  SELECT doc_id, a, b, LEAD(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt,
         ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM r),
t AS (
  SELECT doc_id, SUM(b - a)::BIGINT AS n_removed, COUNT(*) AS n_spans, MIN(a) AS head,
         list(struct_pack(b := b, nxt := nxt) ORDER BY a) AS gaps FROM l GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed,
       COALESCE(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN gaps IS NULL THEN x ELSE substr(x, 1, (2 * head)::BIGINT) || array_to_string(list_transform(gaps,
         lambda g: substr(x, (2 * g.b + 1)::BIGINT, (2 * (COALESCE(g.nxt, len(x) // 2) - g.b))::BIGINT)), '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""


@query("op10_suffix_array", BYTES_SQL)
def op10_suffix_array(spark, sf_dir):
    from rulegauge.llm import suffix_array
    return suffix_array.removed(table(spark, sf_dir, "documents"), texts=False)


# ---- 7: language-model scores ------------------------------------------------------------------------

@query("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    from rulegauge.llm import lm
    docs = table(spark, sf_dir, "documents")
    return lm.scored(docs, lm.train(docs, table(spark, sf_dir, "labels")), leave_out=True)


# ---- 8: token counts under edits ---------------------------------------------------------------------

@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    """Each document loses 20 characters after its first quarter, takes its source and language in at the half, and has
    5 characters after three quarters replaced by its own beginning."""
    from rulegauge.llm import token_counts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    n = F.coalesce(F.length("text"), F.lit(0))

    def edit(share, remove, insert):
        return F.struct(F.floor(n * share).cast("int").alias("at"), F.lit(remove).alias("remove"), insert.alias("insert"))
    edits = F.array(edit(0.25, 20, F.lit("")), edit(0.5, 0, F.concat_ws(" ", F.lit(""), "source", "lang", F.lit(""))),
                    edit(0.75, 5, F.coalesce(F.substring("text", 1, 12), F.lit(""))))
    counted = token_counts.recounted(token_counts.with_trees(docs.select("doc_id", "text", edits.alias("edits"))))
    return counted.select("doc_id", F.col("counts.before").alias("n_tokens"), F.col("counts.after").alias("n_tokens_after"),
                          F.col("counts.encoded").alias("n_chars_encoded"), F.col("counts.length").alias("n_chars_after"))


# ---- 11: collocations --------------------------------------------------------------------------------

COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, SUM(len(w))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS p FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, p, COUNT(*)::BIGINT AS a FROM g GROUP BY lang, k, p HAVING COUNT(*) >= 30),
x AS (
  SELECT lang, q, MAX(a) AS above FROM (
    SELECT lang, a, list_slice(p, b, e) AS q
    FROM f, (SELECT unnest(range(1, 4)) AS b), (SELECT unnest(range(2, 5)) AS e)
    WHERE k > 2 AND e <= k AND e > b AND e - b + 1 < k) GROUP BY lang, q),
c AS (
  SELECT f.lang, f.p, f.k, f.a FROM f LEFT JOIN x ON f.lang = x.lang AND f.p = x.q
  WHERE f.k > 1 AND (above IS NULL OR 100::HUGEINT * above < 80::HUGEINT * f.a)),
y AS (
  SELECT lang, p, a, cut, list_slice(p, 1, cut) AS u, list_slice(p, cut + 1, k) AS v
  FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
t AS (
  SELECT y.lang, y.p, y.a, cut, l.a AS l, r.a AS r, (2000000::HUGEINT * y.a) // (l.a::HUGEINT + r.a) AS score
  FROM y JOIN f l ON l.lang = y.lang AND l.p = y.u JOIN f r ON r.lang = y.lang AND r.p = y.v),
b AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, p ORDER BY score, cut) AS place FROM t) WHERE place = 1),
z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, o.n, score FROM z JOIN o USING (lang) WHERE rank <= 2000"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark, sf_dir):
    from rulegauge.llm import collocations
    return collocations.collocations(table(spark, sf_dir, "documents"))


# ---- 12: main text of pages --------------------------------------------------------------------------

@query("op12_html_text")
def op12_html_text(spark, sf_dir):
    from rulegauge.llm import wrappers
    return wrappers.main_text(table(spark, sf_dir, "pages"))


# ---- 13: spelling variants ---------------------------------------------------------------------------

SPELLING_SQL = r"""
WITH RECURSIVE u AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda k: k::BIGINT)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
e AS (SELECT doc_id, run, COUNT(*) AS n FROM d GROUP BY doc_id, run),
b AS (SELECT *, hex(encode(COALESCE(doc_id::VARCHAR, '') || ':' || run)) AS x FROM e),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2),
           lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])),
         4294967295::BIGINT) AS h FROM b, u),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, SUM(n)::BIGINT AS n FROM w WHERE len(word) >= 7 GROUP BY word HAVING SUM(n) >= 2),
m AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
s AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM m),
p AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM s x JOIN s y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON s.a || s.z = v.word
  UNION SELECT v.word, s.word, s.n FROM s JOIN v ON s.a || s.z = v.word),
g AS (
  SELECT word, COUNT(*) AS n_near, MAX(near_n) AS best_n FROM p GROUP BY word),
k AS (SELECT p.word, MIN(p.near) AS best FROM p JOIN g ON p.word = g.word AND p.near_n = g.best_n GROUP BY p.word),
f AS (
  SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
         CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN g USING (word) LEFT JOIN k USING (word)),
r AS (
  SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""


@query("op13_spelling", SPELLING_SQL)
def op13_spelling(spark, sf_dir):
    from rulegauge.llm import spelling
    return spelling.variants(table(spark, sf_dir, "documents"))


# ---- the pipeline ------------------------------------------------------------------------------------

@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
