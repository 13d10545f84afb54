"""Merkle fixity audit of WARC records.

The records of a file, in their order, are the leaves of a tree of fixed fan-out: each has the digest of its bytes and
its range of offsets, and an inner node digests its children's ranges and digests. Two replicas are compared from the
files' roots down, and only branches that differ are followed. Records below them are told apart by their ids, so that a
lost record, which moves all later ones of its file, is not taken for so many corrupt ones.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked, written

FANOUT = 16
#: Records that a table's rows make up one file of, about.
RECORDS_PER_FILE = 256
BROADCAST_ROWS = 500_000


def record_of(key: Column, url: Column, body: Column) -> Column:
    """A WARC resource record with its head, body and the two line ends after it; nulls count as empty."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"),
    )


def packed(pages: DataFrame, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Records (file, node, id, nth, start, length, sha256) that pages make, one for each key.

    A hash of the key, which may be of any type that has an order, decides the file, and keys are in order there. Rows
    without a key are in file -1. Several rows with one key (or none) are digested together: by how many there are, the
    least and largest hash, and a sum of 64-bit hashes, so no group is gathered.
    """
    id_ = F.col(f"`{key}`")
    file = F.when(id_.isNull(), -1).otherwise(F.pmod(F.xxhash64(id_), F.lit(files))).cast("long")
    record = pages.select(file.alias("file"), id_.alias("id"), record_of(id_, F.col(f"`{url}`"), F.col(f"`{body}`")).alias("r"))
    hashed = record.select("file", "id", F.octet_length("r").cast("long").alias("n"), F.sha2("r", 256).alias("h"))
    total = F.sum(F.xxhash64("h").cast("decimal(38,0)")).cast("string")
    out = hashed.groupBy("file", "id").agg(F.count("*").alias("copies"), F.sum("n").alias("length"), F.min("h").alias("low"), F.max("h").alias("high"), total.alias("total"))
    several = F.sha2(F.concat_ws("|", F.col("copies").cast("string"), "low", "high", "total"), 256)
    out = out.select("file", "id", F.lit(0).alias("nth"), "length", F.when(F.col("copies") == 1, F.col("low")).otherwise(several).alias("sha256"))
    order = Window.partitionBy("file").orderBy("id")  # a file has a bounded number of records
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select("file", (F.row_number().over(order) - 1).cast("long").alias("node"), "id", "nth", start.alias("start"), "length", "sha256")


@dataclass
class Tree:
    """levels[0] holds the leaves (file, node, start, end, digest); the last level has a root for each file."""

    levels: list[DataFrame]


def grown(leaves: DataFrame, top: int, fanout: int = FANOUT, name: str = "tree") -> Tree:
    """leaves: (file, node, start, end, digest) with node from 0 to top. Each level is written to the shared folder."""
    levels = [leaves.select("file", "node", "start", "end", "digest")]
    while top > 0:
        top //= fanout
        child = F.struct("node", "start", "end", "digest")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["start"].cast("string"), x["end"].cast("string"), x["digest"])), "\n")
        levels.append(written(up.select("file", F.col("parent").alias("node"), F.array_min("c.start").alias("start"), F.array_max("c.end").alias("end"), F.sha2(text, 256).alias("digest")), f"{name}-{len(levels)}"))
    return Tree(levels)


def mismatches(a: Tree, b: Tree, fanout: int = FANOUT) -> DataFrame:
    """(file, node) of the leaves that differ, or that only one replica has."""
    below = None
    for x, y in zip(reversed(a.levels), reversed(b.levels)):
        if below is not None:
            up = F.floor(F.col("node") / fanout).cast("long")
            x, y = (t.withColumn("parent", up).join(below, ["file", "parent"], "left_semi") for t in (x, y))
        said = F.struct("start", "end", "digest")
        x, y = x.select("file", "node", said.alias("a")), y.select("file", "node", said.alias("b"))
        last = written(x.join(y, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node"), "differ")
        below = checked(last.withColumnRenamed("node", "parent"), BROADCAST_ROWS)
    return last


def compared(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, id, start, length, sha256, replica_sha256, replica_start, status) for each record of either replica.

    left, right: written tables (file, node, id, nth, start, length, sha256), node being the place in the file and nth
    which of several records with one id it is. status is ok, moved (the same bytes at another offset), corrupt (other
    bytes under the same id), missing (not in right) or extra (not in left).
    """
    top = left.select("node").union(right.select("node")).agg(F.max("node")).first()[0] or 0
    leaf = lambda t: t.select("file", "node", "start", (F.col("start") + F.col("length")).alias("end"), F.col("sha256").alias("digest"))
    bad = checked(mismatches(grown(leaf(left), top, fanout, "left"), grown(leaf(right), top, fanout, "right"), fanout), BROADCAST_ROWS)
    there = right.join(bad, ["file", "node"], "left_semi").select("file", "id", "nth", F.col("sha256").alias("replica_sha256"), F.col("start").alias("replica_start"), F.lit(True).alias("found"))
    there = there.withColumnsRenamed({"file": "_file", "id": "_id", "nth": "_nth"})
    same = (F.col("file") == F.col("_file")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("nth") == F.col("_nth"))
    here = left.join(bad, ["file", "node"], "left_semi")
    both = written(here.join(there, same, "full"), "told-apart")
    status = (
        F.when(F.col("sha256").isNull(), "extra").when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256") != F.col("replica_sha256"), "corrupt")
        .when(F.col("start") != F.col("replica_start"), "moved").otherwise("ok")
    )
    names = ["start", "length", "sha256", "replica_sha256", "replica_start"]
    told = both.select(F.coalesce("file", "_file").alias("file"), F.when(F.col("sha256").isNull(), F.col("_id")).otherwise(F.col("id")).alias("id"), *names, status.alias("status"))
    alike = left.join(bad, ["file", "node"], "left_anti")
    alike = alike.select("file", "id", "start", "length", "sha256", F.col("sha256").alias("replica_sha256"), F.col("start").alias("replica_start"), F.lit("ok").alias("status"))
    return alike.unionByName(told)


def audit(left: DataFrame, right: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", fanout: int = FANOUT) -> DataFrame:
    """One row for each key of either table: page_id, warc_file, start_offset, length, sha256, replica_sha256,
    replica_offset, status (see compared).

    The rows are taken for records of WARC files of about RECORDS_PER_FILE records (see packed). Rows with a null key
    make one record together, with a null page_id, in file -1; rows with the same key as well. Keys may be of any type
    with an order. Null URLs and bodies count as empty. Empty tables are replicas without records.
    """
    files = max(1, -(-left.count() // RECORDS_PER_FILE))
    out = compared(*(written(packed(t, files, key, url, body), name) for name, t in (("left", left), ("right", right))), fanout)
    return out.select(F.col("id").alias(key), F.col("file").alias("warc_file"), F.col("start").alias("start_offset"), "length", "sha256", "replica_sha256", F.col("replica_start").alias("replica_offset"), "status")


def audit_files(spark: SparkSession, left: str, right: str, fanout: int = FANOUT) -> DataFrame:
    """compared of the WARC files in two folders; files are the same if their paths below the folders are."""
    sides = []
    for name, path in (("left", left), ("right", right)):
        records = warc_records(spark, path).drop("uri", "body", "state")
        in_file, of_id = Window.partitionBy("file").orderBy("start"), Window.partitionBy("file", "id").orderBy("start")
        sides.append(written(records.select("file", (F.row_number().over(in_file) - 1).cast("long").alias("node"), "id", F.row_number().over(of_id).alias("nth"), "start", "length", "sha256"), name))
    return compared(*sides, fanout)


#: (offset, length, header fields by lower-case name, body, state)
Parsed = tuple[int, int, dict[str, str], bytes, str]


def _plain(data: bytes, at: int) -> tuple[int, dict[str, str], bytes, str]:
    """End, header, body and state of the record at a place of uncompressed data."""
    following = data.find(b"\r\n\r\nWARC/", at + 1)
    resume = len(data) if following < 0 else following + 4
    if not data.startswith(b"WARC/", at):
        return resume, {}, b"", "malformed"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return len(data), {}, b"", "truncated"
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        return resume, head, data[end + 4 : resume], "malformed"
    stop = end + 4 + int(size)
    if stop > len(data):
        return len(data), head, data[end + 4 :], "truncated"
    return stop + 4 * (data[stop : stop + 4] == b"\r\n\r\n"), head, data[end + 4 : stop], "ok"


def parsed(data: bytes) -> Iterator[Parsed]:
    """The records of a WARC file, plain or with each record a member of gzip. Offsets and lengths are those of the file.

    Header names are taken in any case. A record without a version line or with a Content-Length that is no number is
    malformed and goes on to the next version line after two line ends; one that the file ends within is truncated.
    """
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            member, raw, end = zlib.decompressobj(31), [], at
            try:
                while end < len(data) and not member.eof:
                    raw.append(member.decompress(data[end : end + 65536]))
                    end = min(len(data), end + 65536)
                end -= len(member.unused_data)
                _, head, body, state = _plain(b"".join(raw), 0)
                state = state if member.eof else "truncated"
            except zlib.error:
                following = data.find(b"\x1f\x8b\x08", at + 2)
                end, head, body, state = len(data) if following < 0 else following, {}, b"", "malformed"
        else:
            end, head, body, state = _plain(data, at)
        yield at, end - at, head, body, state
        at = end


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, length, sha256, id, uri, body, state) of the WARC files below path; file is the path below it.

    sha256 is of the stored bytes. A record without an id has @ and its offset for one. A file is read by one task and
    must fit its memory, as Spark's reader of whole files gives it as one row; corpora have files of about 1 GB.
    """
    root = re.sub("^[a-z0-9]+:/*", "/", path).rstrip("/") + "/"

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = name.partition(root)[2] or name.rpartition("/")[2]
                out = []
                for start, length, head, body, state in parsed(data):
                    id_ = head.get("warc-record-id") or f"@{start}"
                    out.append((name, start, length, hashlib.sha256(data[start : start + length]).hexdigest(), id_, head.get("warc-target-uri", ""), body.decode("utf-8", "replace"), state))
                    if len(out) == 256:
                        yield of_rows(out)
                        out = []
                if out:
                    yield of_rows(out)

    def of_rows(out):
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=schema.fieldNames())

    schema = T.StructType.fromDDL("file string, start long, length long, sha256 string, id string, uri string, body string, state string")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return source.select("path", "content").mapInArrow(run, schema)
