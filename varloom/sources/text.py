"""Readers for the four text inputs: header TSV, VCF and FASTA.

All are distributed Spark reads; plain files split across tasks. Block gzip, whatever
its name, is read by byte ranges, one task a range (``varloom.sources.blocks``), where
Python can open the files. Other gzip input (``.gz``) is decoded by Spark but is not
splittable, so such reads are followed by a round-robin repartition to spread the work
after the scan. What a path holds is decided from the files listed under it. Spark
decodes by file name: a ``.bgz`` or ``.gzip`` name has no codec and would be read as
text, so it raises unless the file is block gzip.

TSV columns bind by header name, also across files: where the files' headers differ, the
files are grouped by header, each group is one scan with its own order, and the scans
are united by name.

``checked_tsv``, ``checked_vcf`` and ``checked_fasta`` read the same rows beside a table
of what was rejected: ``file``, ``line`` and ``reason`` (see :class:`Checked`).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.constants import VCF_COLUMNS
from varloom.functions.sequence import fasta_body, fasta_description, fasta_id
from varloom.session import stage
from varloom.sources import blocks

VCF_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in VCF_COLUMNS])

_GZIP_SUFFIX = ".gz"
_UNDECODED_SUFFIXES = (".bgz", ".bgzf", ".gzip")
_TSV = {"sep": "\t", "quote": ""}
#: Files whose first bytes the driver reads at a time.
_OPEN_AT_ONCE = 16


def _as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _check_names(paths: Sequence[str]) -> None:
    for p in paths:
        if p.lower().endswith(_UNDECODED_SUFFIXES):
            raise ValueError(f"{p}: rename gzip files to .gz, Spark does not decode this name (block gzip may keep it)")


def _spread(spark: SparkSession, df: DataFrame, partitions: int | None, gzip: bool) -> DataFrame:
    if partitions:
        return df.repartition(partitions)
    return df.repartition(spark.sparkContext.defaultParallelism) if gzip else df


@dataclass(frozen=True)
class Listing:
    """The files under the given paths: those read by block ranges, and those Spark reads."""

    blocks: tuple[str, ...]
    others: tuple[str, ...]

    @property
    def gzip(self) -> bool:
        """Whether Spark reads some of them in one task a file."""
        return any(f.lower().endswith(_GZIP_SUFFIX) for f in self.others)


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> Listing:
    """Every file under ``paths``; the first bytes of those with a gzip name decide how each is read."""
    files = [path for path, _ in blocks.file_sizes(spark, _as_list(paths))]
    named = [f for f in files if f.lower().endswith((_GZIP_SUFFIX, *_UNDECODED_SUFFIXES))]
    with ThreadPoolExecutor(_OPEN_AT_ONCE) as pool:
        found = {f for f, good in zip(named, pool.map(blocks.readable_blocks, named)) if good}
    others = tuple(f for f in files if f not in found)
    _check_names(others)
    return Listing(tuple(sorted(found)), others)


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _from_lines(lines: DataFrame, schema: T.StructType, *kept: str) -> DataFrame:
    """The rows that Spark's CSV reader makes of ``value``, one each, beside the columns ``kept``."""
    row = F.from_csv("value", _ddl(schema), _TSV)
    return lines.select(*kept, row.alias("__row")).select(*kept, *[F.col(f"__row.`{c}`").alias(c) for c in schema.names])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names)


# ---------------------------------------------------------------------------
# Header TSV
# ---------------------------------------------------------------------------


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, gzip decoded; None of an empty file. Reads the file's start on the driver."""
    if path.lower().endswith((_GZIP_SUFFIX, *_UNDECODED_SUFFIXES)) and blocks.readable_blocks(path):
        stream, size = blocks.open_file(path)
        with stream:
            text = next(blocks.owned_text(blocks.Blocks(path, stream, size), 0, 1), b"")
        return text.splitlines()[0].decode("utf-8", "replace") if text else None
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).open(target)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(target)
    reader = jvm.java.io.BufferedReader(
        jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
    )
    try:
        return reader.readLine()
    finally:
        reader.close()


@dataclass(frozen=True)
class Header:
    """One header line and the files that have it."""

    line: str
    files: Listing

    @property
    def names(self) -> tuple[str, ...]:
        # Spark's CSV writer puts its (absent) quote, NUL, around a first name that starts with '#'.
        return tuple(n.strip("\0") or f"_c{i}" for i, n in enumerate(self.line.split("\t")))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType(), True) for n in self.names])


def headers(spark: SparkSession, listing: Listing, columns: Sequence[str] | None = None) -> list[Header]:
    """The different headers of the files, by path; files without any line are left out.

    A name that stands twice in a header raises, and so does a header without one of ``columns``.
    """
    files = sorted((*listing.blocks, *listing.others))
    with ThreadPoolExecutor(_OPEN_AT_ONCE) as pool:
        lines = dict(zip(files, pool.map(lambda f: first_line(spark, f), files)))
    groups: dict[str, list[str]] = {}
    for path, line in lines.items():
        if line is not None:
            groups.setdefault(line.rstrip("\r"), []).append(path)
    out = []
    for line, own in groups.items():
        header = Header(line, Listing(*(tuple(f for f in part if f in set(own)) for part in (listing.blocks, listing.others))))
        names = header.names
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{own[0]}: a column name stands twice in the header")
        missing = [c for c in columns or [] if c not in names]
        if missing:
            raise ValueError(f"{own[0]}: the header has no column {missing[0]!r}")
        out.append(header)
    return out


def _all_names(found: Sequence[Header]) -> list[str]:
    return list(dict.fromkeys(n for header in found for n in header.names))


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def read_tsv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Header-named TSV as strings, quoting off.

    Columns bind by each file's own header. ``columns`` may hold names with dots; a file
    without one of them raises. Without ``columns`` all names come back, in the order in
    which the files (by path) first have them, null where a file lacks one.
    """
    listing = list_files(spark, paths)
    found = headers(spark, listing, columns)
    names = list(columns) if columns is not None else _all_names(found)
    frames = []
    for header in found:
        own = _quoted([n for n in names if n in header.names])
        if header.files.others:
            # One header everywhere: the paths as given, so that Spark lists them its own way.
            alone = len(found) == 1 and header.files == listing and not listing.blocks
            files = _as_list(paths) if alone else list(header.files.others)
            df = spark.read.schema(header.schema).options(header=True, **_TSV).csv(files).select(own)
            frames.append(_spread(spark, df, partitions, header.files.gzip))
        if header.files.blocks:
            lines = blocks.block_lines(spark, header.files.blocks)
            rows = _from_lines(lines.filter((F.col("value") != header.line) & (F.col("value") != "")), header.schema)
            frames.append(_spread(spark, rows.select(own), partitions, False))
    if not frames:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) or "value string")
    return _united(frames).select(_quoted(names))


# ---------------------------------------------------------------------------
# VCF and FASTA
# ---------------------------------------------------------------------------


def _no_id(df: DataFrame) -> DataFrame:
    return df.withColumn("ID", F.nullif("ID", F.lit(".")))


def read_vcf(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """VCF body lines as the eight fixed columns; ``#`` lines are skipped.

    Extra per-sample columns are ignored by the fixed schema. An id of ``.`` means
    that the record has none and is read as null.
    """
    listing = list_files(spark, paths)
    frames = []
    if listing.others or not listing.blocks:
        df = spark.read.schema(VCF_SCHEMA).options(comment="#", header=False, **_TSV).csv(list(listing.others) or _as_list(paths))
        frames.append(_spread(spark, df, partitions, listing.gzip))
    if listing.blocks:
        frames.append(_spread(spark, vcf_rows(blocks.block_lines(spark, listing.blocks)), partitions, False))
    return _no_id(_united(frames))


def vcf_rows(lines: DataFrame) -> DataFrame:
    """The eight fixed columns of VCF lines (``value``), comments and blank lines left out."""
    return _from_lines(lines.filter(~F.startswith("value", F.lit("#")) & (F.col("value") != "")), VCF_SCHEMA)


def read_vcf_blocks(spark: SparkSession, paths: str | Sequence[str], range_bytes: int | None = None) -> DataFrame:
    """``read_vcf`` of block-gzip files whatever they are named; other files raise."""
    return _no_id(vcf_rows(blocks.block_lines(spark, _as_list(paths), range_bytes)))


def read_fasta(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """One row per FASTA record: ``id``, ``description``, ``sequence``.

    Records are split on ``\\n>`` by the text reader, so a ``>`` inside a
    header is not a record boundary and multi-line bodies stay together.
    """
    return fasta_rows(_fasta_records(spark, paths, partitions)).filter(F.col("id") != "")


def _fasta_records(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    paths = _as_list(paths)
    raw = spark.read.option("lineSep", "\n>").text(paths)
    files = raw.inputFiles()
    _check_names(files)
    gzip = any(f.lower().endswith(_GZIP_SUFFIX) for f in files)
    return _spread(spark, raw.select("value", F.col("_metadata.file_path").alias("file")), partitions, gzip)


def fasta_rows(raw: DataFrame, *kept: str) -> DataFrame:
    return raw.select(
        *kept,
        fasta_id(F.col("value")).alias("id"),
        fasta_description(F.col("value")).alias("description"),
        fasta_body(F.col("value")).alias("sequence"),
    )


# ---------------------------------------------------------------------------
# Rejected rows
# ---------------------------------------------------------------------------

REJECTED = ("file", "line", "reason")


@dataclass(frozen=True)
class Checked:
    """Two readings of one staged scan: the good rows, and ``file``, ``line``, ``reason`` of every other line.

    Together they are what was read: lines that hold a record at all, so neither blank
    lines nor headers nor comments.
    """

    rows: DataFrame
    rejected: DataFrame


def _checked(parsed: DataFrame, columns: Sequence[str], name: str) -> Checked:
    """``parsed``: the columns, file, line and reason (null of a good row). The input is scanned once, by this write."""
    bad = F.col("__reason").isNotNull()
    staged = stage(
        parsed.select(
            *[F.when(~bad, F.col(f"`{c}`")).alias(c) for c in columns],
            F.when(bad, F.col("__file")).alias("__file"), F.when(bad, F.col("__line")).alias("__line"), "__reason",
        ),
        name,
    )
    return Checked(
        staged.filter(~bad).select(*[F.col(f"`{c}`") for c in columns]),
        staged.filter(bad).select(*[F.col(f"__{c}").alias(c) for c in REJECTED]),
    )


def _lines(spark: SparkSession, listing: Listing) -> DataFrame:
    """value, file of every line that is not blank."""
    frames = []
    if listing.others:
        df = spark.read.text(list(listing.others)).select("value", F.col("_metadata.file_path").alias("file"))
        frames.append(_spread(spark, df, None, listing.gzip))
    if listing.blocks:
        frames.append(blocks.block_lines(spark, listing.blocks).select("value", "file"))
    return _united(frames).filter(F.col("value") != "")


_MARKS = ("__file", "__line", "__reason")


def _marked(lines: DataFrame, reason: Column) -> DataFrame:
    return lines.select("value", F.col("file").alias("__file"), F.col("value").alias("__line"), reason.alias("__reason"))


def _n_fields(value: str = "value") -> Column:
    return F.length(value) - F.length(F.replace(F.col(value), F.lit("\t"))) + 1


def checked_tsv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> Checked:
    """``read_tsv``; a line with fewer or more fields than its file's header is rejected.

    A line that equals its file's header is one, wherever it stands.
    """
    found = headers(spark, list_files(spark, paths), columns)
    names = list(columns) if columns is not None else _all_names(found)
    frames = []
    for header in found:
        lines = _lines(spark, header.files).filter(F.col("value") != header.line)
        n, width = _n_fields(), len(header.names)
        of = F.concat(n.cast("string"), F.lit(f" of {width} fields"))
        reason = F.when(n < width, F.concat(F.lit("short: "), of)).when(n > width, F.concat(F.lit("long: "), of))
        frames.append(_from_lines(_marked(lines, reason), header.schema, *_MARKS))
    if not frames:
        frames = [spark.createDataFrame([], ", ".join(f"`{n}` string" for n in [*names, *_MARKS]))]
    return _checked(_united(frames), names, "checked_tsv")


def checked_vcf(spark: SparkSession, paths: str | Sequence[str]) -> Checked:
    """``read_vcf``; a line with fewer than the eight fixed fields is rejected."""
    lines = _lines(spark, list_files(spark, paths)).filter(~F.startswith("value", F.lit("#")))
    n, width = _n_fields(), len(VCF_COLUMNS)
    reason = F.when(n < width, F.concat(F.lit("short: "), n.cast("string"), F.lit(f" of {width} fields")))
    return _checked(_no_id(_from_lines(_marked(lines, reason), VCF_SCHEMA, *_MARKS)), VCF_COLUMNS, "checked_vcf")


def checked_fasta(spark: SparkSession, paths: str | Sequence[str]) -> Checked:
    """``read_fasta``; a record without an id is rejected (its first line is given). Blank text is no record."""
    raw = _fasta_records(spark, paths).filter(F.regexp_replace("value", r"[>\s]+", "") != "")
    head = F.regexp_extract("value", r"^>?([^\r\n]*)", 1)
    rows = fasta_rows(raw.withColumns({"__file": F.col("file"), "__line": head}), "__file", "__line")
    reason = F.when(F.col("id") == "", F.lit("no id"))
    return _checked(rows.withColumn("__reason", reason), ["id", "description", "sequence"], "checked_fasta")


def write_tsv(df: DataFrame, path: str) -> None:
    """Header TSV, quoting off (the inverse of :func:`read_tsv`)."""
    df.write.mode("overwrite").options(header=True, sep="\t", quote="", escapeQuotes=False).csv(path)
