"""Hash-chained ledgers: build, link, verify, export."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.operators.ordered import dense_index, previous_row
from rulegauge.session import materialize, work_path
from rulegauge.sources.commits import CommitLog

GENESIS = "0" * 64
LINK_TILE = 100_000
# Keys of the hashed payload and the columns they come from. The engine-version key is a parameter, so that a
# ledger written under another name for it can be checked.
_PAYLOAD = {
    "sequence_number": "sequence_number", "previous_hash": "previous_hash", "timestamp": "timestamp_iso",
    "verdict": "verdict", "telemetry_id": "telemetry_id", "telemetry_hash": "telemetry_hash", "rule_id": "rule_id",
    "kg_version": "kg_version", "reasoning": "reasoning", "track": "track",
}


def entry_payload(version_key: str = "model_version") -> Column:
    """Canonical JSON of an entry: sorted keys, compact, nulls kept."""
    fields = {**_PAYLOAD, version_key: "model_version"}
    return V.struct_json(*[F.col(c).alias(k) for k, c in sorted(fields.items())])


def entry_hash(version_key: str = "model_version") -> Column:
    return F.sha2(entry_payload(version_key), 256)


def envelope_hash(text: Column, *, exact: bool = False) -> Column:
    """``sha256:`` + hash of the canonical form of envelope JSON text."""
    canonical = V.canonical_json_exact(text) if exact else V.canonical_json(F.try_parse_json(text))
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def measurement_hash(measurement: Column) -> Column:
    return F.sha2(V.canonical_json(measurement), 256)


# ---- build ----------------------------------------------------------------------------------

def build_chain(verdicts: DataFrame, *, ledger: str = "tenant_id", order: list[str] | None = None,
                heads: DataFrame | None = None, version_key: str = "model_version",
                segment_rows: int = 200_000) -> DataFrame:
    """Adds ``sequence_number``, ``previous_hash`` and ``entry_hash`` per ledger.

    Needs ``timestamp_iso, verdict, telemetry_id, telemetry_hash, rule_id, kg_version, model_version,
    reasoning, track``. ``heads`` (ledger, ``sequence_number``, ``entry_hash``) continues existing ledgers.

    An entry's hash needs the hash before it, so one ledger is folded in order; ledgers run side by side. Places
    come from a balanced range sort, and a long ledger is folded in segments of ``segment_rows``: each round
    folds one segment of every ledger that reaches that far and hands its head to the next round through the
    written table. The entries pass through the fold in order, a batch at a time, and leave it with their hashes: they
    are shuffled once and not joined with the hashes afterwards.
    """
    order = order or ["timestamp_iso", "telemetry_id"]
    spark = verdicts.sparkSession
    columns = verdicts.columns
    placed = dense_index(verdicts, keys=[ledger], order=order, name="sequence_number")
    if heads is not None:
        base = heads.select(ledger, F.col("sequence_number").alias("_base"), F.col("entry_hash").alias("_tip"))
        placed = (placed.join(base, ledger, "left")
                  .withColumn("_rank", F.col("sequence_number"))
                  .withColumn("sequence_number", F.col("sequence_number") + F.coalesce("_base", F.lit(0))))
    else:
        placed = placed.withColumn("_rank", F.col("sequence_number")).withColumn("_tip", F.lit(None).cast("string"))
    staged = materialize(
        placed.select(*columns, "sequence_number", "_tip", F.col("_rank").cast("bigint").alias("_rank"),
                      F.floor((F.col("_rank") - 1) / segment_rows).cast("int").alias("_segment")), "segments", by="_segment")
    rounds = (staged.agg(F.max("_segment")).first()[0] or 0) + 1
    target = work_path(spark, "chain")
    kept = [*columns, "sequence_number", "_rank"]
    out_schema = staged.select(*kept).schema.add("previous_hash", "string").add("entry_hash", "string")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by rank and leave with their hashes; Python holds one batch of them
        tip, last = None, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            tip = tip or rows["_tip"][0].as_py() or GENESIS
            ranks, before, after = rows["_rank"].to_pylist(), [], []
            if ranks[0] < last or any(a > b for a, b in zip(ranks, ranks[1:])):
                raise RuntimeError("entries of a ledger must come in order")
            last = ranks[-1]
            for head, tail in zip(rows["_head"].to_pylist(), rows["_tail"].to_pylist()):
                before.append(tip)
                tip = hashlib.sha256((head + tip + tail).encode("utf-8")).hexdigest()
                after.append(tip)
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), pa.array(before, pa.string()), pa.array(after, pa.string())],
                                             names=[*kept, "previous_hash", "entry_hash"])

    def text(rows: DataFrame) -> DataFrame:
        # The text around the previous hash, made where it is folded: it is neither written nor moved. Quotes inside values are
        # escaped, so the key below is found nowhere else.
        key = '"previous_hash":"'
        whole = rows.withColumn("previous_hash", F.lit("")).withColumn("_text", entry_payload(version_key))
        cut = F.instr("_text", key) + len(key)
        return whole.withColumns({"_head": F.substr("_text", F.lit(1), cut - 1), "_tail": F.substr("_text", cut)})

    for number in range(rounds):
        part = staged.filter(F.col("_segment") == number).select(*kept, "_tip")
        if number:
            tips = (spark.read.parquet(f"{target}/_round={number - 1}").filter(F.col("_rank") == number * segment_rows)
                    .select(ledger, F.col("entry_hash").alias("_tip")))
            part = part.drop("_tip").join(tips, ledger)
        placed_part = part.repartition(ledger).sortWithinPartitions(ledger, "_rank")
        (text(placed_part).select(*kept, "_head", "_tail", "_tip").groupBy(ledger).applyInArrow(fold, out_schema)
         .write.parquet(f"{target}/_round={number}"))
    written = spark.read.schema(out_schema).option("basePath", target).parquet(*[f"{target}/_round={n}" for n in range(rounds)])
    return written.select(*columns, "sequence_number", "previous_hash", "entry_hash")


def heads_of(ledger_rows: DataFrame, *, ledger: str = "tenant_id") -> DataFrame:
    """Last sequence number and hash per ledger."""
    return ledger_rows.groupBy(ledger).agg(
        F.max("sequence_number").alias("sequence_number"),
        F.max_by("entry_hash", "sequence_number").alias("entry_hash"))


def append_ledger(entries: DataFrame, path: str, *, ledger: str = "tenant_id") -> None:
    """Append entries as one commit; refuses entries whose (ledger, sequence number) is already stored.

    Each commit leaves its zone map: first and last number, count and head per ledger. An append compares maps and opens
    only the commits whose range of numbers meets its own, so a clean append reads no stored entry. The commit counts
    from the moment it has its version; a writer that comes too late for one looks at what the winner wrote and tries again.
    """
    spark = entries.sparkSession
    log, name = CommitLog(spark, path), uuid.uuid4().hex
    data, zone = f"{path}/commit={name}", f"{path}/_zones/{name}"
    entries.withColumn("day", F.to_date(F.substring("timestamp_iso", 1, 10))).write.partitionBy("day").parquet(data)
    new = spark.read.schema(entries.schema.add("day", "date")).parquet(data)
    new.groupBy(ledger).agg(
        F.min("sequence_number").alias("first_number"), F.max("sequence_number").alias("last_number"), F.count(F.lit(1)).alias("n"),
        F.max_by("entry_hash", "sequence_number").alias("head")).withColumn("commit", F.lit(name)).write.parquet(zone)
    seen: set[str] = set()
    older = log.unlogged()
    if older:
        _refuse(append_conflicts(new, spark.read.option("basePath", path).parquet(*older), ledger=ledger), log, name)
    while True:
        commits = log.commits()
        fresh = [c for c in commits if c not in seen]
        if fresh:
            meeting = overlapping(spark.read.parquet(zone), zones(spark, path, fresh), ledger=ledger)
            if meeting:
                stored = spark.read.option("basePath", path).parquet(*[f"{path}/commit={c}" for c in meeting])
                _refuse(append_conflicts(new, stored, ledger=ledger), log, name)
            seen |= set(fresh)
        if log.put(len(commits), name):
            return


def _refuse(conflicts: DataFrame, log: CommitLog, name: str) -> None:
    if not conflicts.isEmpty():
        log.drop(f"commit={name}")
        log.drop("_zones", name)
        raise ValueError("append-only: an entry with this ledger and sequence number is already stored")


def zones(spark: SparkSession, path: str, commits: list[str] | None = None) -> DataFrame:
    """The zone map of a stored ledger: a row per commit and ledger."""
    chosen = CommitLog(spark, path).commits() if commits is None else commits
    return spark.read.parquet(*[f"{path}/_zones/{c}" for c in chosen])


def overlapping(new: DataFrame, stored: DataFrame, *, ledger: str = "tenant_id") -> list[str]:
    """Names of the stored commits that share a range of numbers with the new one in some ledger."""
    mine = new.select(ledger, F.col("first_number").alias("_first"), F.col("last_number").alias("_last"))
    met = stored.join(mine, ledger).filter((F.col("first_number") <= F.col("_last")) & (F.col("_first") <= F.col("last_number")))
    return sorted(r.commit for r in met.select("commit").distinct().collect())


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The committed entries of a stored ledger; what a writer left behind without a commit is not seen."""
    folders = [f"{path}/commit={c}" for c in CommitLog(spark, path).commits()]
    return spark.read.option("basePath", path).parquet(*folders).drop("commit")


def append_conflicts(entries: DataFrame, stored: DataFrame, *, ledger: str = "tenant_id") -> DataFrame:
    """New entries that would overwrite a stored one: same ledger and number."""
    return entries.join(stored.select(ledger, "sequence_number"), [ledger, "sequence_number"], "left_semi")


def history_changes(before: DataFrame, after: DataFrame, *, ledger: str = "tenant_id") -> DataFrame:
    """Entries of ``before`` that ``after`` no longer holds unchanged: ``REMOVED`` or ``REWRITTEN``."""
    now = after.select(ledger, "sequence_number", F.col("entry_hash").alias("_now"))
    joined = before.join(now, [ledger, "sequence_number"], "left")
    change = F.when(F.col("_now").isNull(), "REMOVED").when(F.col("_now") != F.col("entry_hash"), "REWRITTEN")
    return joined.withColumn("change", change).filter("change IS NOT NULL").select(ledger, "sequence_number", "change")


# ---- linkage and verification -------------------------------------------------------------------

def with_previous(ledger_rows: DataFrame, *, ledger: str = "tenant_id", tile: int = LINK_TILE) -> DataFrame:
    return previous_row(ledger_rows, keys=[ledger], order=["sequence_number"],
                        tile=F.floor(F.col("sequence_number") / tile).cast("bigint"),
                        values=["sequence_number", "entry_hash", "timestamp_iso"])


def chain_linkage(ledger_rows: DataFrame, *, ledger: str = "tenant_id", tile: int = LINK_TILE) -> DataFrame:
    """Adds ``expected_previous_hash`` and ``chain_link_valid`` from the stored hashes only."""
    linked = with_previous(ledger_rows, ledger=ledger, tile=tile)
    expected = F.col("prev_entry_hash")
    valid = F.col("sequence_number").eqNullSafe(1) | (expected.isNotNull() & expected.eqNullSafe(F.col("previous_hash")))
    return (linked.withColumn("expected_previous_hash", expected).withColumn("chain_link_valid", valid)
            .drop("prev_sequence_number", "prev_entry_hash", "prev_timestamp_iso"))


def checked(ledger_rows: DataFrame, *, ledger: str = "tenant_id", version_key: str = "model_version",
            tile: int = LINK_TILE) -> DataFrame:
    """Adds the four findings per entry: ``seq_gap``, ``link_broken``, ``hash_broken``, ``time_back``."""
    # the entry's own hash is checked before rows are moved, so that the recomputed one stays behind
    own = ~entry_hash(version_key).eqNullSafe(F.col("entry_hash"))
    rows = ledger_rows.withColumn("hash_broken", F.col("entry_hash").isNull() | own)
    linked = with_previous(rows, ledger=ledger, tile=tile)
    expected_seq = F.coalesce(F.col("prev_sequence_number"), F.lit(0)) + 1
    expected_hash = F.coalesce(F.col("prev_entry_hash"), F.lit(GENESIS))
    now, before = V.parse_iso(F.col("timestamp_iso")), V.parse_iso(F.col("prev_timestamp_iso"))
    return (linked.withColumn("expected_sequence", expected_seq)
            .withColumn("seq_gap", ~F.col("sequence_number").eqNullSafe(expected_seq))
            .withColumn("link_broken", ~F.col("previous_hash").eqNullSafe(expected_hash))
            .withColumn("time_back", now.isNull() | F.coalesce(now < before, F.lit(False)))
            .drop("prev_sequence_number", "prev_entry_hash", "prev_timestamp_iso"))


def chain_issues(ledger_rows: DataFrame, *, ledger: str = "tenant_id", version_key: str = "model_version",
                 tile: int = LINK_TILE) -> DataFrame:
    """One row per finding: ledger, sequence number, issue type, severity, description."""
    found = checked(ledger_rows, ledger=ledger, version_key=version_key, tile=tile)
    seq = F.col("sequence_number")

    def issue(when, name, number, words):
        return F.when(when, F.struct(F.lit(name).alias("issue_type"), number.alias("sequence_number"),
                                     words.alias("description")))

    rows = F.array_compact(F.array(
        issue(F.col("seq_gap"), "SEQUENCE_GAP", F.col("expected_sequence"), F.concat(
            F.lit("Expected sequence "), F.col("expected_sequence").cast("string"), F.lit(", found "),
            seq.cast("string"))),
        issue(F.col("link_broken"), "HASH_MISMATCH", seq, F.lit("previous_hash does not match the entry before")),
        issue(F.col("hash_broken"), "ENTRY_HASH_MISMATCH", seq, F.lit("recomputed hash differs from the stored hash")),
        issue(F.col("time_back"), "TIMESTAMP_ORDER", seq, F.lit("timestamp is unreadable or lies before the entry before"))))
    return (found.select(ledger, F.explode(rows).alias("i"))
            .select(ledger, "i.sequence_number", "i.issue_type", F.lit("CRITICAL").alias("severity"), "i.description"))


def verify_chain(ledger_rows: DataFrame, *, ledger: str = "tenant_id", version_key: str = "model_version",
                 tile: int = LINK_TILE) -> DataFrame:
    """One summary row per ledger."""
    found = checked(ledger_rows, ledger=ledger, version_key=version_key, tile=tile)
    flags = ("seq_gap", "link_broken", "hash_broken", "time_back")
    n = {f: F.count_if(F.col(f)) for f in flags}
    total = F.count(F.lit(1))
    summary = found.groupBy(ledger).agg(
        total.alias("total_entries"), F.min("sequence_number").alias("first_sequence"),
        F.max("sequence_number").alias("last_sequence"), *[n[f].alias("n_" + f) for f in flags])
    issues = F.col("n_seq_gap") + F.col("n_link_broken") + F.col("n_hash_broken") + F.col("n_time_back")
    return summary.select(
        ledger, "total_entries", "first_sequence", "last_sequence", (F.col("n_seq_gap") == 0).alias("chain_continuity"),
        (F.col("total_entries") - F.col("n_link_broken")).alias("chain_link_verified_count"),
        (F.col("total_entries") - F.col("n_hash_broken")).alias("entry_hash_verified_count"),
        (F.col("n_time_back") == 0).alias("timestamp_ordering"), issues.alias("issue_count"),
        (issues == 0).alias("is_valid"))


def sequence_gaps(ledger_rows: DataFrame, *, ledger: str = "tenant_id", tile: int = LINK_TILE) -> DataFrame:
    """Entries that do not follow their predecessor, with how many numbers are missing before them."""
    slim = ledger_rows.select(ledger, "sequence_number", "timestamp_iso", F.lit("").alias("entry_hash"))
    linked = with_previous(slim, ledger=ledger, tile=tile)
    missing = F.col("sequence_number") - F.coalesce(F.col("prev_sequence_number"), F.lit(0)) - 1
    return linked.withColumn("missing", missing).filter("missing <> 0").select(
        ledger, "sequence_number", "timestamp_iso", "missing")


def constraint_issues(ledger_rows: DataFrame, *, ledger: str = "tenant_id") -> DataFrame:
    """Rows that break the table's rules: verdict, status, empty track, repeated number or hash."""
    def bad(when, name):
        return F.when(F.coalesce(when, F.lit(False)), F.lit(name))

    row_rules = F.array_compact(F.array(
        bad(F.col("verdict").isNull() | ~F.col("verdict").isin(*P.VERDICTS), "verdict"),
        bad(F.col("verifier_status").isNotNull() & ~F.col("verifier_status").isin(*P.STATUSES), "verifier_status"),
        bad(F.col("track") == "", "track")))
    by_row = ledger_rows.select(ledger, "sequence_number", F.explode(row_rules).alias("constraint_name"))

    def repeated(column, name):
        groups = ledger_rows.groupBy(ledger, column).agg(
            F.count(F.lit(1)).alias("n"), F.min("sequence_number").alias("_at")).filter("n > 1")
        return groups.select(ledger, F.col("_at").alias("sequence_number"), F.lit(name).alias("constraint_name"))

    return by_row.unionByName(repeated("sequence_number", "unique_sequence_number")) \
        .unionByName(repeated("entry_hash", "unique_entry_hash"))


def transcript_hashes(transcripts: DataFrame, *, exact: bool = True) -> DataFrame:
    """Adds recomputed request/response hashes, the message a signature covers, and ``hashes_match``."""
    canonical = V.canonical_json_exact(F.col("response")) if exact else V.canonical_json(F.try_parse_json("response"))
    request = F.concat(F.lit("sha256:"), F.sha2("request", 256))
    response = F.concat(F.lit("sha256:"), F.sha2(canonical, 256))
    out = transcripts.withColumn("recomputed_request", request).withColumn("recomputed_response", response)
    match = (F.col("recomputed_request") == F.col("request_hash")) & F.coalesce(
        F.col("recomputed_response") == F.col("response_hash"), F.lit(False))
    return out.withColumn("hashes_match", match).withColumn(
        "signing_message", F.concat("request_hash", F.lit("|"), "response_hash"))


# ---- export and paging -----------------------------------------------------------------------

def select_entries(ledger_rows: DataFrame, *, start: str | None = None, end: str | None = None,
                   verdict: str | None = None, rule_id: str | None = None, fields: list[str] | None = None,
                   limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Filtered, projected, ordered entries; ``start`` and ``end`` are inclusive."""
    out = ledger_rows
    if start:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if verdict:
        out = out.filter(F.col("verdict") == verdict)
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    out = out.orderBy(*(order or ["tenant_id", "sequence_number"]))
    if limit:
        out = out.limit(int(limit))
    return out.select(*fields) if fields else out


def export(ledger_rows: DataFrame, path: str, fmt: str = "jsonl", **filters) -> DataFrame:
    """Write entries as ``json``/``jsonl`` (one object a line) or ``csv``; returns per-file counts and checksum."""
    chosen = select_entries(ledger_rows, **filters)
    if fmt in ("json", "jsonl"):
        chosen.write.option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        chosen.write.option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
    files = chosen.sparkSession.read.format("binaryFile").load(path)
    return files.select(F.col("path"), F.col("length").alias("size_bytes"),
                        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"))


def page(ledger_rows: DataFrame, *, limit: int, offset: int, order: list[str] | None = None) -> DataFrame:
    return ledger_rows.orderBy(*(order or ["tenant_id", "sequence_number"])).offset(offset).limit(limit)
