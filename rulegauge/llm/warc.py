"""WARC archives: written from pages by Spark's text writer, read back by boundary-chain verification.

The magic line starts every record, but a payload may hold it too. Reading, tasks take pieces of any size of any file;
each occurrence of the magic is a candidate, and its own length field names its successor. Pointer jumping from the
start of each file keeps the candidates that are reachable, so magic inside payloads is never a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulegauge.llm.common import scalar, stored

MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column, worked out in the JVM: 160 bits are 8 groups of 20."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``payload_bytes, payload_digest, record_type, refers_to``.

    Of pages with equal payloads of at least ``min_bytes`` the one with the largest page_id is the response and the
    others revisit it; NULL ids count as the smallest; equal ids with equal payloads are all responses. Only payloads
    that occur twice meet the pages again, by a join that the optimizer broadcasts if they are few.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"),
                         base32_sha1(html.cast("binary")).alias("payload_digest"))
    twice = (keyed.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1 and _best is not null").drop("_n"))
    joined = keyed.join(stored(twice, "repeated"), "payload_digest", "left")
    revisit = F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("_best")).alias("refers_to"))


def _one_line(text: Column) -> Column:
    """Control characters would end or forge a header line: they are percent-encoded."""
    for code in [*range(32), 127]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return text


def write(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html), as uncompressed WARC files under ``path``.

    NULL html is an empty payload; a NULL id or url leaves its header out. Other columns are not looked at. Spark's text
    writer commits the files, so lost executors leave no torn archives.
    """
    page = marked(pages, min_bytes)

    def header(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    html = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, html))

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    framed = page.select("*", block.alias("block"))
    record = F.concat(
        F.lit(MAGIC), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", urn("page_id")),
        header("WARC-Refers-To", urn("refers_to")), F.lit(f"WARC-Date: {date}\r\n"),
        header("WARC-Target-URI", _one_line(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, f"WARC-Profile: {_PROFILE}\r\n").otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(_END), F.col("block"))
    framed.select(record.alias("value")).write.option("lineSep", _END).text(path)


# ---- reading -----------------------------------------------------------------------------------------

def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Text between occurrences of the magic, with the piece (file, start of split) it was read in.

    Every scan of the frame must cut the files alike, whatever executors come or go and settings change in between. Splits
    follow the settings of the session that made the relation: it is one of its own, with the parallelism of this moment.
    """
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(key, spark.conf.get(key))
    cores = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    own.conf.set("spark.sql.files.minPartitionNum", cores or str(spark.sparkContext.defaultParallelism))
    read_ = own.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # an empty union, which the optimizer drops: all but the splits follows the caller's session
    return spark.createDataFrame([], read_.schema).filter(F.lit(False)).union(read_)


_LINKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("leave", pa.int64()),
                    ("size", pa.int64())])


def _links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate of a piece: where its chain leaves the piece; offsets count from the piece's first magic.

    A chain that runs into something that is no candidate leaves nowhere. One more row of a piece (``at`` = -1) has its
    size. Rows of a piece stand together and in order, as the scan reads them.
    """
    def finish(file, block, found, size):
        leave = {}
        for start, after in reversed(found):
            leave[start] = None if after is None else after if after >= size else leave.get(after)
        return [(file, block, at, to, None) for at, to in leave.items()] + [(file, block, -1, None, size)]

    done, piece, found, size = [], None, [], 0
    for batch in rows:
        for file, block, n, head, length in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, block) != piece:
                if piece is not None:
                    done += finish(*piece, found, size)
                piece, found, size = (file, block), [], 0
                if block == 0:  # what stands before the first magic of a file
                    size = n
                    continue
            after = None if length is None else size + len(MAGIC) + head + length + len(_END)
            found.append((size, after))
            size += len(MAGIC) + n
        if len(done) > 50_000:
            yield _table(done, _LINKS)
            done = []
    yield _table(done + (finish(*piece, found, size) if piece is not None else []), _LINKS)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _entries(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """The first reachable record of each piece: ``file, block, place, entry`` (NULL if no record starts there).

    Pointer jumping doubles the steps each round, so the rounds are the logarithm of the pieces of a file; chains inside
    a piece are already contracted. All tables but the candidates have a row per piece.
    """
    text = F.col("value")
    head = F.substring_index(text, _END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1)
    narrow = segments.select(
        "file", "block", F.octet_length(text).cast("long").alias("n"),
        (F.octet_length(head) + len(_END)).cast("long").alias("head"),
        F.when(F.contains(text, F.lit(_END)) & (length != ""), length.cast("long")).alias("length"))
    links = stored(narrow.mapInArrow(_links, "file string, block bigint, at bigint, leave bigint, size bigint"), "links")
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(links.filter("at = -1").select(
        "file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.row_number().over(in_file).alias("place")), "pieces")
    jumps = stored(links.filter("at >= 0").join(pieces, ["file", "block"]).select(
        "file", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("leave")).alias("to")), "jumps")
    reached = jumps.filter("at = 0").select("file", "at")
    steps, most = 1, scalar(pieces.agg(F.max("place")))[0] or 1
    while steps < most:
        step = reached.join(jumps.hint("merge"), ["file", "at"]).filter("to is not null").select("file", F.col("to").alias("at"))
        reached = stored(reached.union(step), "reached")
        ahead = jumps.hint("merge").select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = stored(jumps.join(ahead, ["file", "to"]).select("file", "at", F.col("_to").alias("to")), "jumps")
        steps *= 2
    # the piece of a reached offset: the last piece whose base is not beyond it
    marks = pieces.select("file", F.col("base").alias("at"), F.lit(0).alias("kind"), "block", "base").unionByName(
        reached.distinct().withColumn("kind", F.lit(1)), allowMissingColumns=True)
    by_offset = Window.partitionBy("file").orderBy("at", "kind")
    found = (marks.select("file", "at", "kind", F.last("block", True).over(by_offset).alias("block"),
                          F.last("base", True).over(by_offset).alias("base")).filter("kind = 1")
             .groupBy("file", "block").agg(F.min(F.col("at") - F.col("base")).alias("entry")))
    return stored(pieces.join(found, ["file", "block"], "left").select("file", "block", "place", "entry"), "entries")


_RECORDS = pa.schema([("file", pa.string()), ("place", pa.int64()), ("starts", pa.bool_()), ("whole", pa.bool_()),
                      ("data", pa.binary())])


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each piece, followed from its entry. A record that the piece's end cuts comes in parts.

    ``whole`` records have all their bytes; else ``starts`` tells a record's first part from what continues one.
    """
    done, held = [], 0
    piece, size, expect, need, parts_, file, place = None, 0, None, 0, [], None, None

    def close(starts):
        nonlocal parts_, held
        data = b"".join(parts_)
        if data:
            whole = starts and need is not None and len(data) >= need
            done.append((file, place, starts, whole, data[:need] if whole else data))
            held += len(data)
        parts_ = []

    begun = False
    for batch in rows:
        for f, block, value, p, entry in zip(*[c.to_pylist() for c in batch.columns]):
            if (f, block) != piece:
                close(begun)
                if p is None:
                    raise ValueError(f"{f} was cut at {block} in one scan only: its records would be lost")
                piece, size, expect, need, begun, file, place = (f, block), 0, entry, None, False, f, p
                if block == 0:
                    size = len(value)
                    continue
            if expect is not None and size == expect:
                close(begun)
                begun, length = True, _length(value)
                need = None if length is None else len(MAGIC) + value.index(b"\r\n\r\n") + 4 + length
                expect = None if need is None else size + need + len(_END)
            parts_.append(MAGIC.encode() + value)
            size += len(MAGIC) + len(value)
            if held > 8 << 20:
                yield _table(done, _RECORDS)
                done, held = [], 0
    close(begun)
    yield _table(done, _RECORDS)


_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$")


def _length(value: bytes) -> int | None:
    head, found, _ = value.partition(b"\r\n\r\n")
    match = _LENGTH.search(head) if found else None
    return int(match[1]) if match else None


_PARSED = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload", pa.binary())])


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def _parsed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header fields and payload of complete records; size and digest of a revisit are those its headers name."""
    def number(urn):
        match = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(match[1]) if match else None
    for batch in rows:
        out = []
        for data in batch.column(0).to_pylist():
            head, _, block = data.partition(b"\r\n\r\n")
            length = _length(data[len(MAGIC):])
            if length is None or len(block) < length:  # its file ends too early
                continue
            about, block = _fields(head), block[:length]
            http, _, payload = block.partition(b"\r\n\r\n")
            kind, digest = about.get("warc-type"), about.get("warc-payload-digest", "").removeprefix("sha1:")
            said = _fields(http).get("content-length")
            if kind == "response":
                digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            else:
                size, payload = int(said) if said else None, None
            out.append((number(about.get("warc-record-id")), kind, number(about.get("warc-refers-to")),
                        about.get("warc-target-uri"), digest, size, payload))
        yield _table(out, _PARSED)


def read(spark: SparkSession, path: str, *, small: int = 200_000) -> DataFrame:
    """Records of the archives under ``path``: ``page_id, record_type, refers_to, url, payload_digest, payload_bytes,
    payload``.

    Files may be of any size. A record that the end of its file cuts off is left out, and so is whatever is not
    reachable from the start of its file. Entries of pieces go to the tasks by broadcast up to ``small`` pieces (a row
    of about 100 bytes each); beyond that pieces and entries meet by a join that brings each piece together again. A piece
    without an entry is an error.
    """
    segments = _segments(spark, path)
    entries = _entries(spark, segments)
    read_ = segments.select("file", "block", F.col("value").cast("binary").alias("value"))
    if scalar(entries.agg(F.count(F.lit(1))))[0] <= small:
        met = read_.join(F.broadcast(entries), ["file", "block"], "left")
    else:
        met = (read_.withColumn("_seq", F.monotonically_increasing_id()).join(entries, ["file", "block"], "left")
               .repartition("file", "block").sortWithinPartitions("file", "block", "_seq"))
    cut = met.select("file", "block", "value", F.col("place").cast("long"), "entry").mapInArrow(
        _cut, "file string, place bigint, starts boolean, whole boolean, data binary")
    in_file = Window.partitionBy("file").orderBy("place", "starts")
    part = (cut.filter("not whole").withColumn("_record", F.sum(F.col("starts").cast("int")).over(in_file))
            .filter("_record > 0").groupBy("file", "_record")
            .agg(F.array_sort(F.collect_list(F.struct("place", "starts", "data"))).alias("_all")))
    joined = part.select(F.aggregate(F.transform("_all", lambda x: x["data"]), F.lit(b""),
                                     lambda a, b: F.concat(a, b)).alias("data"))
    return cut.filter("whole").select("data").unionByName(joined).mapInArrow(_parsed, (
        "page_id bigint, record_type string, refers_to bigint, url string, payload_digest string, payload_bytes bigint, "
        "payload binary"))
