"""WARC archives with a merged capture index.

``write_archives`` puts one WARC/1.1 record per page into archive files: Spark's
own text writer appends the record separator, so the files are committed like any
Spark output, on any file system, and survive lost executors. Each file is sorted
by URL key and timestamp: it is a capture run. ``read_archives`` parses the files
back by Content-Length and recomputes each digest. ``merge_index`` splits the
index lines into ranges of (URL key, timestamp) and, in each range, merges the
sorted segments of all runs with a loser tree; the output files together are one
globally ordered capture history.

Of the records with equal payloads (UTF-8 of the html; null counts as empty), the
one with the smallest page_id is the response; the others are revisit records
without a block that name it. Repeated rows (same page_id and payload) are all the
response. A null url has the empty URL key; a null page_id sorts before any other
and is written as an empty header value. Extra columns are ignored; an empty table
gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, id_order

#: Captures carry no fetch time; page_id seconds after this instant stands for it.
EPOCH = "2024-01-01 00:00:00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows per archive file, so that a reader holds one bounded file at a time.
RECORDS_PER_FILE = 5_000
URI_CHARACTERS = "!#$%&'()*+,/:;=?@[]~"
NULL_ID = -(2**63)

INDEX_SCHEMA = (
    "run string, seq long, url_key string, captured_at string, page_id long, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, record_offset long, record_length long"
)


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host, then the lower-cased path and query."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "")
    reversed_host = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(reversed_host, F.lit(")"), rest))


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, key, time, and for each payload its smallest page_id (``first_id``).

    Payload groups are found on digests alone, with map-side minima, so a payload
    that a third of the pages share is one row per map task there. The html moves
    once, in the join with the minima; a hot digest is split by the adaptive join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("payload_key", F.sha2(F.encode("html", "UTF-8"), 256))
    firsts = rows.groupBy("payload_key").agg(F.min(id_order("page_id")).alias("first_id"))
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))
    stamp = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + seconds)
    return rows.join(firsts, "payload_key").select(
        "page_id", "url", "html", "first_id",
        url_key(F.col("url")).alias("url_key"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
        (id_order("page_id") != F.col("first_id")).alias("is_revisit"),
    )


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            payload = row["html"].encode("utf-8")
            pid = "" if row["page_id"] is None else str(row["page_id"])
            head = [
                "WARC/1.1",
                f"WARC-Type: {'revisit' if row['is_revisit'] else 'response'}",
                f"WARC-Record-ID: <urn:page:{pid}>",
                f"WARC-Target-URI: {quote(row['url'], safe=URI_CHARACTERS)}",
                f"WARC-Date: {row['captured_at']}",
                f"WARC-Payload-Digest: sha1:{_digest(payload)}",
                f"X-Url-Key: {json.dumps(row['url_key'])}",
            ]
            if row["is_revisit"]:
                first = "" if row["first_id"] == NULL_ID else row["first_id"]
                head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
                block = ""
            else:
                block = row["html"]
            head += ["Content-Type: text/html", f"Content-Length: {len(block.encode('utf-8'))}"]
            out.append("\r\n".join(head) + "\r\n\r\n" + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(caps: DataFrame, path: str) -> None:
    """Write the captures as gzipped WARC files under ``path``, each sorted by URL key and time."""
    (
        caps.sortWithinPartitions("url_key", "captured_at", "page_id")
        .mapInArrow(_render, "value string")
        .write.mode("overwrite")
        .option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; a torn file raises."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        stop = end + 4 + size
        if len(block) != size or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"torn WARC record at byte {at}")
        yield at, stop + 4 - at, headers, block
        at = stop + 4


def _id_in(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in INDEX_SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for seq, (offset, length, h, block) in enumerate(parse_records(gzip.decompress(content.as_py()))):
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                response = h["WARC-Type"] == "response"
                if response and _digest(block) != digest:
                    raise ValueError(f"payload digest mismatch in {path} at byte {offset}")
                rows.append((
                    path, seq, json.loads(h["X-Url-Key"]), h["WARC-Date"], _id_in(h["WARC-Record-ID"]), h["WARC-Type"],
                    None if response else _id_in(h["WARC-Refers-To"]), len(block) if response else None, digest,
                    offset, length,
                ))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archives(spark, path: str) -> DataFrame:
    """One index line per record of the archives under ``path`` (a file is a locally sorted run)."""
    # Listed without inference, so a folder without a file is an empty table.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_index, INDEX_SCHEMA)


class LoserTree:
    """k-way merge of sorted sequences: each internal node keeps the loser of its match."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.k
        winner = [-1] * (2 * self.k)
        for i in range(len(runs)):
            winner[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winner[1] if self.k > 1 else (0 if runs else -1)

    def _head(self, i: int):
        return self.runs[i][self.at[i]] if i >= 0 and self.at[i] < len(self.runs[i]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        while (item := self._head(self.top)) is not None:
            yield item
            run = self.top
            self.at[run] += 1
            node = (run + self.k) // 2
            while node >= 1 and self.k > 1:
                if not self._before(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.top = run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    runs_of = whole.column("run").to_pylist()
    keys = list(zip(
        whole.column("url_key").to_pylist(), whole.column("captured_at").to_pylist(),
        (-(2**63) if p is None else p for p in whole.column("page_id").to_pylist()), range(len(runs_of)),
    ))
    runs: list[list] = []
    for i, run in enumerate(runs_of):
        if i == 0 or run != runs_of[i - 1]:
            runs.append([])
        runs[-1].append(keys[i])
    order = [key[-1] for key in LoserTree(runs)]
    yield from whole.take(pa.array(order, pa.int64())).combine_chunks().to_batches()


def merge_index(index: DataFrame) -> DataFrame:
    """The index lines in global order of (URL key, timestamp, page id), one range per partition.

    Every range holds, for each run, a sorted segment (``run``, ``seq`` order); the
    segments are merged with a loser tree. The range bounds are sampled by Spark and
    take the page id too, so a URL or host with a third of all captures spans ranges.
    """
    ranged = index.repartitionByRange("url_key", "captured_at", "page_id").sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(_merge, INDEX_SCHEMA)


def capture_history(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged capture index.

    A revisit's payload length is that of the response it refers to.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(captures(pages), scratch.path("archives"))
    history = scratch.stage(merge_index(read_archives(spark, scratch.path("archives"))), "history")
    sizes = (
        history.filter("record_type = 'response'")
        .groupBy(id_order("page_id").alias("response_id"), "payload_digest")
        .agg(F.max("payload_bytes").alias("response_bytes"))
    )
    revisits = history.filter("record_type = 'revisit'").withColumn("response_id", id_order("refers_to"))
    found = revisits.join(sizes, ["response_id", "payload_digest"], "left").select(
        *[c for c in history.columns if c != "payload_bytes"], F.col("response_bytes").alias("payload_bytes")
    )
    return history.filter("record_type = 'response'").unionByName(found)
