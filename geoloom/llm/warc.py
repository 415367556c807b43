"""Merkle fixity audit of WARC records.

Each replica of an archive is a table of records in files: file, offset,
length, digest. The digests of a file's records, in the order of their offsets,
are the leaves of a tree whose nodes cover offset ranges; the file roots are
the leaves of the archive's tree. Two replicas are compared from the root, and
only the branches that differ are descended, down to the corrupt records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import written

#: Children of a tree node.
FAN_OUT = 16
#: Records of one WARC file, by page id.
FILE_RECORDS = 512

VERSION = "WARC/1.1"
LINE = "\r\n"


def record_bytes(uri: Column, page_id: Column, payload: Column) -> Column:
    """A WARC resource record for each row, as bytes of UTF-8: header, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    header = F.concat(
        F.lit(f"{VERSION}{LINE}WARC-Type: resource{LINE}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(f">{LINE}WARC-Target-URI: "),
        F.coalesce(uri, F.lit("")), F.lit(f"{LINE}Content-Type: text/html{LINE}Content-Length: "), F.octet_length(body).cast("string"), F.lit(LINE + LINE),
    )
    return F.concat(header, body, F.lit(LINE + LINE)).cast("binary")


def archive(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Lays pages(page_id, url, html) out as WARC records: file, page_id, record.

    A file holds a range of page ids. A null page_id goes to file -1. Repeated
    rows are records of their own.
    """
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1)).cast("long").alias("file"), F.col("page_id").cast("long").alias("page_id"),
        record_bytes(F.col("url"), F.col("page_id"), F.col("html")).alias("record"),
    )


def index(records: DataFrame) -> DataFrame:
    """Offsets and digests of archive(file, page_id, record): file, at, page_id, offset, length, digest.

    Records stand in the order of page_id, then digest. Payloads are hashed
    where they are read; only digests and lengths are shuffled.
    """
    hashed = records.select("file", "page_id", F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return hashed.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("at"), "page_id",
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "digest",
    )


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """One level up: the digest of a node covers its children's digests and ranges, in order."""
    up = nodes.groupBy("file", F.floor(F.col("at") / fan_out).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "low", "high", "digest"))).alias("kids"))
    said = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["low"], k["high"], k["digest"])), ",")
    return up.select("file", F.col("up").alias("at"), F.element_at("kids", 1)["low"].alias("low"), F.array_max(F.transform("kids", lambda k: k["high"])).alias("high"), F.sha2(said, 256).alias("digest"))


def heights(replicas: list[DataFrame], fan_out: int = FAN_OUT) -> tuple[int, int]:
    """Levels above the leaves that the fullest file and the number of files need; the same for all replicas, so that nodes match."""
    records = files = 1
    for r in replicas:
        most = r.agg(F.max("at"), F.max("file")).first()
        # File numbers start at -1, for records without an id.
        records, files = max(records, (most[0] or 0) + 1), max(files, (most[1] or 0) + 2)
    rise = lambda n: next(k for k in range(64) if fan_out**k >= n)
    return rise(records), rise(files)


def tree(indexed: DataFrame, within: int, above: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first, each a written table (file, at, low, high, digest).

    Leaves are records. `within` levels go up to one node for each file; those
    are then the leaves of the archive's own `above` levels up to one root. In
    the archive's levels `file` is null, and `at` and the ranges count files.
    """
    level = written(indexed.select("file", "at", F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), "digest"), "fixity-level")
    levels = [level]
    for _ in range(within):
        level = written(_parents(level, fan_out), "fixity-level")
        levels.append(level)
    roots = level.select(F.lit(None).cast("long").alias("file"), (F.col("file") + 1).alias("at"), F.col("file").alias("low"), F.col("file").alias("high"), "digest")
    levels.append(written(roots, "fixity-level"))
    for _ in range(above):
        levels.append(written(_parents(levels[-1], fan_out), "fixity-level"))
    return levels


def differing_leaves(left: list[DataFrame], right: list[DataFrame], within: int, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[int]]:
    """Leaves (file, at) that the replicas do not share, and how many nodes were compared on each level, from the root down.

    A level's nodes are compared only below nodes that differ one level up.
    """
    suspects, compared = None, []
    for k in range(len(left) - 1, -1, -1):
        a, b = left[k], right[k]
        if suspects is not None:
            if k == within:  # from the archive's leaves to the files' own roots
                above, on = suspects.select((F.col("at") - 1).alias("s_file")), F.col("file") == F.col("s_file")
            else:
                above = suspects.select(F.col("file").alias("s_file"), F.col("at").alias("s_at"))
                on = F.col("file").eqNullSafe(F.col("s_file")) & (F.floor(F.col("at") / fan_out) == F.col("s_at"))
            a, b = a.join(above, on, "left_semi"), b.join(above, on, "left_semi")
        b = b.toDF("b_file", "b_at", "b_low", "b_high", "b_digest")
        paired = a.join(b, F.col("file").eqNullSafe(F.col("b_file")) & (F.col("at") == F.col("b_at")), "full")
        same = (F.col("digest") == F.col("b_digest")) & (F.col("low") == F.col("b_low")) & (F.col("high") == F.col("b_high"))
        found = written(paired.select(F.coalesce("file", "b_file").alias("file"), F.coalesce("at", "b_at").alias("at"), F.coalesce(~same, F.lit(True)).alias("differs")), "fixity-compared")
        compared.append(found.count())
        suspects = found.where("differs").select("file", "at")
        if suspects.isEmpty():
            break
    return suspects, compared


def audit(primary: DataFrame, replica: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Every record of the primary with whether the replica holds the same bytes at the same place.

    primary and replica: archive(file, page_id, record). Returns page_id, file,
    record_no, record_offset, length, digest, intact, found_digest (of the
    replica's record of the same number in the file, if it differs). Records
    that only the replica has are rows without a digest. An empty primary gives
    only those. Null payloads are records without a body.
    """
    ours = written(index(primary), "fixity-index")
    theirs = written(index(replica), "fixity-index")
    within, above = heights([ours, theirs], fan_out)
    bad, _ = differing_leaves(tree(ours, within, above, fan_out), tree(theirs, within, above, fan_out), within, fan_out)
    bad = bad.select(F.col("file").alias("bad_file"), F.col("at").alias("bad_at"))
    wrong = theirs.join(bad, (F.col("file") == F.col("bad_file")) & (F.col("at") == F.col("bad_at"))).select(F.col("file").alias("r_file"), F.col("at").alias("r_at"), F.col("digest").alias("found_digest"), F.col("page_id").alias("r_page"))
    marked = ours.join(bad, (F.col("file") == F.col("bad_file")) & (F.col("at") == F.col("bad_at")), "left").drop("bad_at")
    full = marked.join(wrong, (F.col("file") == F.col("r_file")) & (F.col("at") == F.col("r_at")), "full")
    return full.select(
        F.coalesce("page_id", "r_page").alias("page_id"), F.coalesce("file", "r_file").alias("file"), F.coalesce("at", "r_at").alias("record_no"),
        F.col("offset").alias("record_offset"), "length", "digest", (F.col("bad_file").isNull() & F.col("r_file").isNull()).alias("intact"), "found_digest",
    )


def damaged(pages: DataFrame, one_in: int = 97, at: int = 13) -> DataFrame:
    """A replica with planted damage: where page_id leaves `at` on division by `one_in`, the first character of html is '?'."""
    hit = (F.pmod(F.col("page_id"), F.lit(one_in)) == at) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("?"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html")))


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            at, n = 0, 0
            while at < len(content):
                head_end = content.index(b"\r\n\r\n", at) + 4
                fields = dict(x.split(b": ", 1) for x in content[at:head_end].split(b"\r\n")[1:] if b": " in x)
                stop = head_end + int(fields[b"Content-Length"]) + 4
                out.append((path, n, fields.get(b"WARC-Record-ID", b"").decode(), fields.get(b"WARC-Target-URI", b"").decode(), at, stop - at, bytes(content[head_end : stop - 4])))
                at, n = stop, n + 1
        yield pd.DataFrame(out, columns=["path", "record_no", "record_id", "uri", "record_offset", "length", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files: path, record_no, record_id, uri, record_offset, length, payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_files, "path string, record_no long, record_id string, uri string, record_offset long, length long, payload binary")
