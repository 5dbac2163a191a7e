"""WARC files: a writer with revisit records and a reader that verifies boundaries.

Files are plain WARC/1.1 records one after the other, written and split by
Spark's own text source, so any store that Spark reads will do and a lost task
is simply run again. The reader takes every place where the magic stands as a
candidate record, lets tasks emit candidate-to-successor offsets, and finds by
pointer jumping from each file's start which candidates are records; magic
inside a payload is never reached.

Jumping goes in two levels, so that no task holds a file: within a block (a
split of the scan) each candidate's chain is followed to where it leaves the
block, and those exits are joined with one another, twice as far each round,
until the entries of all blocks are known; from them each block marks its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from trustloom.llm.common import stored

MAGIC = "WARC/1.1\r\n"
#: Records after which the writer begins another file.
FILE_RECORDS = 50_000
#: Equal payloads of at least so many bytes become revisits.
MIN_REVISIT = 0
#: Copies of a repeated payload's reference, over which its revisits are spread.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@pandas_udf(StringType())
def base32_sha1(sha: pd.Series) -> pd.Series:
    """Base32 of hexadecimal SHA-1 digests; null stays null."""
    import base64

    return sha.map(lambda x: None if x is None else base64.b32encode(bytes.fromhex(x)).decode())


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (string), payload_bytes, sha (hex), refers_to: null for a response.

    A null payload is an empty one. Of equal payloads the one with the largest
    id is the response, and so are rows that repeat it; rows with a null id are
    responses of their own.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha": F.sha1(F.col("payload").cast("binary"))})
    # Ids and digests alone are shuffled. A hot digest's reference is copied to SALTS buckets, so no task gets
    # all its pages. The revisits found are stored: the planner knows their size, sends a small table to all and
    # only deals the payloads out for a large one.
    narrow = rows.select("page_id", "sha").filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_revisit))
    first = narrow.groupBy("sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    first = first.filter("_n > 1").select("sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    again = narrow.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(first, ["sha", "_salt"])
    again = again.filter("page_id <> _first").select("page_id", F.col("_first").alias("refers_to"), F.col("sha").alias("_sha")).distinct()
    again = stored(again, "revisits")
    out = rows.join(again, (rows["page_id"] == again["page_id"]) & (rows["sha"] == again["_sha"]), "left").select(*[rows[c] for c in rows.columns], "refers_to")
    return out.select("page_id", "url", "payload", "payload_bytes", "sha", "refers_to")


def _one_line(c) -> F.Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", " ")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Write a response or revisit record per page below ``path``.

    Repeated rows give a record each; payloads of any length are written whole.
    Extra columns, whatever their names, are ignored, and an empty table gives
    an archive without records. Control characters in a URL become spaces. All
    records bear the time of the call as their date.
    """
    rows = records(pages, page_id, url, html, min_revisit)
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.concat(
        line("WARC-Date", F.lit(date)),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("sha")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    # The text source writes the bytes as they are; its separator is the two line ends after each record.
    out = rows.select(F.concat(F.lit(MAGIC), head, F.lit("\r\n"), body).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add pos: the bytes of a block's pieces, and of the magic behind each, before this one. A block's rows come in order."""
    last, total = None, 0
    for batch in batches:
        if not len(batch):
            continue
        own = batch.column("bytes").to_numpy() + len(MAGIC)
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        new = np.array([a != b for a, b in zip(keys, [last, *keys])])
        before = np.cumsum(own) - own + (0 if new[0] else total)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        pos = before - np.where(new.cumsum() > 0, before[begin], 0)
        last, total = keys[-1], int(pos[-1] + own[-1])
        yield pa.record_batch([*batch.columns, pa.array(pos, pa.int64())], [*batch.schema.names, "pos"])


def _pieces(spark: SparkSession, path: str, *columns) -> DataFrame:
    """A row per piece of a file between magic and magic: file, block, bytes, pos and ``columns`` of its value.

    Split by the magic, so a file of any size is read by many tasks. Pieces
    cover the file but for the magic between them.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("long").alias("bytes"), *columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_positions, f"{kinds}, pos long")


def _hops(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, successor's offset, successor's place in the block or the number of candidates) in the order of offsets."""
    offset, span = part["offset"].to_numpy(np.int64), part["span"].to_numpy(np.int64)
    succ = np.where(span >= 0, offset + span, -1)
    at = np.minimum(np.searchsorted(offset, succ), len(offset) - 1)
    return offset, succ, np.where((succ > offset) & (offset[at] == succ), at, len(offset))


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block the first offset of its chain that isn't one of the block."""
    part = part.sort_values("offset", ignore_index=True)
    offset, succ, jump = _hops(part)
    n, way = len(offset), np.arange(len(offset))
    jump = np.append(jump, n)
    while True:  # the last candidate of each chain, by doubling
        further = jump[way]
        inside = further < n
        if not inside.any():
            break
        way = np.where(inside, further, way)
        jump = np.append(np.where(jump[jump[:n]] < n, jump[jump[:n]], jump[:n]), n)
    return pd.DataFrame({"file": part["file"], "offset": offset, "exit": succ[way]})


def _reached(part: pd.DataFrame) -> pd.DataFrame:
    """Which candidates of a block its entries reach: reached |= jump[reached], jump = jump[jump]."""
    part = part.sort_values("offset", ignore_index=True)
    offset, _, jump = _hops(part)
    n = len(offset)
    jump, real = np.append(jump, n), np.append(part["entry"].to_numpy(bool), False)
    while True:
        more = real.copy()
        more[jump[np.flatnonzero(real)]] = True
        more[n] = False
        if (more == real).all():
            break
        real, jump = more, jump[jump]
    last = np.maximum.accumulate(np.where(real[:n], np.arange(n), -1))
    owner = np.where(last >= 0, offset[np.maximum(last, 0)], -1)
    return part.assign(real=real[:n], owner=owner)[["file", "block", "bytes", "span", "offset", "real", "owner"]]


def _entries(exits: DataFrame, rounds: int) -> DataFrame:
    """(file, offset): candidates by which the chain from a file's start enters a block."""
    found = exits.filter("offset = 0").select("file", "offset")
    for _ in range(rounds):
        step = found.join(exits, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        found = stored(found.unionByName(step.join(exits.select("file", "offset"), ["file", "offset"], "left_semi")).distinct(), "entries")
        further = exits.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        exits = stored(exits.join(further, ["file", "exit"], "left").select("file", "offset", F.coalesce("far", "exit").alias("exit")), "exits")
    return found


def index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (file, block, bytes, span, offset, real, owner) and where each block begins (file, block, base).

    ``owner`` is the offset of the record that a piece belongs to, -1 for none.
    """
    head = F.substring_index("value", "\r\n\r\n", 1)
    length = F.nullif(F.regexp_extract(head, r"(?m)^Content-Length: ([0-9]{1,18})\r?$", 1), F.lit("")).cast("long")
    # magic, header, blank line, body, two line ends
    span = F.when(F.contains(F.col("value"), F.lit("\r\n\r\n")), F.lit(len(MAGIC)) + F.octet_length(head) + 4 + length + 4)
    found = stored(_pieces(spark, path, F.coalesce(span, F.lit(-1)).cast("long").alias("span")), "pieces")
    # A row a block.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("file", "block").agg(F.max(F.col("pos") + F.col("bytes") + len(MAGIC)).alias("size"))
    bases = stored(blocks.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "bases")
    offset = F.col("base") + F.col("pos") - len(MAGIC)
    rows = stored(found.join(bases, ["file", "block"]).select("file", "block", "bytes", "span", offset.alias("offset")), "offsets")
    exits = stored(rows.filter("span >= 0 and offset >= 0").groupBy("file", "block").applyInPandas(_exits, "file string, offset long, exit long"), "exits")
    most = bases.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    entries = _entries(exits, (most - 1).bit_length()).withColumn("entry", F.lit(True))
    marked = rows.join(entries, ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    out = stored(marked.groupBy("file", "block").applyInPandas(_reached, "file string, block long, bytes long, span long, offset long, real boolean, owner long"), "reached")
    # A record that began in an earlier block owns a block's first pieces.
    tops = out.groupBy("file", "block").agg(F.max("owner").alias("top"))
    tops = stored(tops.select("file", "block", F.coalesce(F.max("top").over(before), F.lit(-1)).alias("carried")), "tops")
    return out.join(tops, ["file", "block"]).withColumn("owner", F.greatest("owner", "carried")).drop("carried"), bases


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_type, page_id, url, refers_to, payload_digest, payload_bytes, payload, sound.

    Only records that a file's start reaches; magic within payloads rejected
    by the chain stays payload. A response's digest and bytes are those of the
    payload read, a revisit's those of its header; ``sound`` says whether a
    response's payload has the digest and length of its header. Groups hold the
    offsets, never payloads, of one block of a file of any size.
    """
    found, bases = index(spark, path)
    magic = len(MAGIC)
    body = _pieces(spark, path, F.col("value").cast("binary").alias("raw")).filter("bytes > 0").join(bases, ["file", "block"], "left")
    offset = F.coalesce(F.col("base"), F.raise_error(F.lit("the archive was split differently between two scans")).cast("long")) + F.col("pos") - magic
    body = body.select("file", offset.alias("offset"), "raw")
    # Nearly all pieces are whole records. The rest is stored, so that the planner knows how small it is, and
    # payloads stay where they are scanned unless an archive is full of false magic.
    rest = stored(found.filter(f"bytes > 0 and not (real and span = bytes + {magic})").select("file", "offset", "owner"), "rest")
    keys = ["file", "offset"]
    single = body.join(rest.select(*keys), keys, "left_anti").select("raw")
    # Records whose payload holds the magic: their pieces are put together again.
    many = body.join(rest.filter("owner >= 0"), keys).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "raw"))).alias("p"))
    glued = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0))["raw"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["raw"]))
    rows = single.unionByName(many.select(glued.alias("raw")))
    text = F.col("raw").cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    field = lambda name, pattern: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: {pattern}\r?$", 1), F.lit(""))
    rows = rows.withColumn("head", head)
    size = field("Content-Length", "([0-9]{1,18})").cast("long")
    rows = rows.select(
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Record-ID", r"<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        field("WARC-Refers-To", r"<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("said_digest"),
        field("X-Payload-Length", "([0-9]{1,18})").cast("long").alias("said_bytes"),
        F.substr("raw", F.octet_length("head") + 5, size.cast("int")).alias("payload"),
    )
    revisit = F.col("record_type") == "revisit"
    # Evaluated once a row: the digest goes through Python.
    rows = rows.withColumns({"own_bytes": F.octet_length("payload").cast("long"), "own_digest": base32_sha1(F.sha1("payload"))})
    return rows.select(
        "record_type",
        "page_id",
        "url",
        "refers_to",
        F.when(revisit, F.col("said_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        "payload",
        (revisit | ((F.col("own_bytes") == F.col("said_bytes")) & (F.col("own_digest") == F.col("said_digest")))).alias("sound"),
    )
