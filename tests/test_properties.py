"""Operators against plain-Python brute force on random inputs."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions.hgvs import with_name_parts
from varloom.operators.dedupe import keep_first
from varloom.operators.missense import has_consequence

SETTINGS = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))

small_text = st.one_of(st.none(), st.sampled_from(["", "a", "b", "ab", "B", "a b"]))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3", None]), small_text, small_text,
                          st.one_of(st.none(), st.integers(-2, 2))), min_size=1, max_size=40))
def test_keep_first_is_the_minimum_row(spark, rows):
    df = spark.createDataFrame(rows, "k string, a string, b string, c int")

    def order(r):  # nulls first, then ascending, column by column: (a, c), then the rest (b)
        return tuple((v is not None, v) for v in (r[1], r[3], r[2]))

    expected = {}
    for r in rows:
        if r[0] not in expected or order(r) < order(expected[r[0]]):
            expected[r[0]] = r
    got = {r["k"]: tuple(r) for r in keep_first(df.repartition(3), ["k"], ["a", "c"]).collect()}
    assert got == expected


residues = ["Ala", "Arg", "Ter", "Met", "Gly", "Xaa"]
name_part = st.one_of(
    st.builds(lambda nm, g, c, p: f"{nm}({g}):c.{c}A>G{p}",
              st.sampled_from(["NM_000059.4", "NM_1.2", "NR_9.1"]), st.sampled_from(["BRCA2", "G1", "X"]),
              st.integers(1, 9999),
              st.one_of(st.just(""), st.builds(lambda r, pos, alt: f" (p.{r}{pos}{alt})",
                                               st.sampled_from(residues), st.integers(0, 5000),
                                               st.sampled_from(residues + ["=", "?", "*", "fs"])))),
    st.text(alphabet="NM_().:>pAGcg0123456789 =?", max_size=30),
)


def _python_parts(name):
    def ex(pattern, s):
        m = re.search(pattern, s)
        return m.group(1) if m else ""

    snv = ex(r"p\.([A-Za-z0-9]+)", name)
    return (ex(r"^([^()]+)\(", name), ex(r"\(([^)]+)\)", name), snv,
            ex(r"^([A-Za-z]+)", snv), ex(r"([0-9]+)", snv), ex(r"([A-Za-z]+)$", snv))


@SETTINGS
@given(st.lists(name_part, min_size=1, max_size=30))
def test_name_parts_match_python_regexes(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, Name string")
    got = {r["i"]: tuple(r[c] for c in ("transcription", "gene", "SNV", "REF", "POS", "ALT"))
           for r in with_name_parts(df).collect()}
    assert got == {i: _python_parts(n) for i, n in enumerate(names)}


info_entry = st.one_of(
    st.builds(lambda vals: "MC=" + ",".join(vals),
              st.lists(st.sampled_from(["SO:1|missense_variant", "SO:2|intron_variant", "SO:3|synonymous_variant"]),
                       min_size=1, max_size=3)),
    st.sampled_from(["ALLELEID=5", "ORIGIN=1", "FLAG", "XMC=SO:1|missense_variant", "CLNSIG=Benign"]),
)


def _python_missense(info):
    if info is None:
        return False
    for entry in info.split(";"):
        if entry.startswith("MC="):
            return any("missense_variant" in v for v in entry[3:].split(","))
    return False


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.builds(";".join, st.lists(info_entry, min_size=1, max_size=4))),
                min_size=1, max_size=30))
def test_missense_filter_matches_python(spark, infos):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(infos)], "i int, INFO string")
    got = {r["i"]: r["m"] for r in df.select("i", has_consequence(F.col("INFO")).alias("m")).collect()}
    assert got == {i: _python_missense(s) for i, s in enumerate(infos)}


record = st.tuples(
    st.builds(lambda p, k: f"{p}_{k:06d}.1", st.sampled_from(["NP", "XP", "YP"]), st.integers(0, 999999)),
    st.text(alphabet="abc >[]=-", max_size=20),
    st.text(alphabet="ACDEFGHIKLMNPQRSTVWY", min_size=1, max_size=300),
    st.integers(5, 80),
)


def _python_fasta(text):
    out, current = {}, None
    for line in text.splitlines():
        if line.startswith(">"):
            header = line[1:]
            current = header.split()[0] if header.split() else ""
            out[current] = ""
        elif current is not None:
            out[current] += line.strip()
    return out


@SETTINGS
@given(st.lists(record, min_size=1, max_size=12, unique_by=lambda r: r[0]), st.booleans())
def test_fasta_reader_matches_python(spark, tmp_path_factory, records, crlf):
    from varloom.sources.text import read_fasta

    nl = "\r\n" if crlf else "\n"
    parts = []
    for rid, desc, seq, width in records:
        body = nl.join(seq[i:i + width] for i in range(0, len(seq), width))
        parts.append(f">{rid} {desc}".rstrip() + nl + body + nl)
    text = "".join(parts)
    path = tmp_path_factory.mktemp("fasta") / "p.faa"
    path.write_bytes(text.encode())
    got = {r["id"]: r["sequence"] for r in read_fasta(spark, str(path)).collect()}
    assert got == _python_fasta(text)


cell = st.text(alphabet='ab "\',.|#-x', max_size=8)


@SETTINGS
@given(st.lists(st.tuples(cell, cell, cell), min_size=1, max_size=20))
def test_tsv_reader_round_trip(spark, tmp_path_factory, rows):
    from varloom.sources.text import read_tsv

    path = tmp_path_factory.mktemp("tsv") / "t.tsv"
    path.write_text("c1\tc2\tc3\n" + "".join("\t".join(r) + "\n" for r in rows))
    got = sorted((tuple(r) for r in read_tsv(spark, str(path), columns=["c1", "c2", "c3"]).collect()), key=repr)
    # Empty fields read as null, and a line of only tabs and blanks is a blank line
    # that Spark's CSV reader skips: both as with the original's reader.
    want = sorted((tuple(v if v != "" else None for v in r) for r in rows if "\t".join(r).strip()), key=repr)
    assert got == want


vcf_field = st.text(alphabet="ACGT.:=|,;_0123456789", min_size=1, max_size=12)


@SETTINGS
@given(st.lists(st.tuples(st.lists(vcf_field, min_size=8, max_size=10), st.booleans()), min_size=1, max_size=25))
def test_vcf_reader_matches_python(spark, tmp_path_factory, lines):
    from varloom.sources.text import read_vcf

    text = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    for fields, meta in lines:
        if meta:
            text += "##meta=" + fields[0] + "\n"
        text += "\t".join(fields) + "\n"
    path = tmp_path_factory.mktemp("vcf") / "a.vcf"
    path.write_text(text)
    got = sorted(tuple(r) for r in read_vcf(spark, str(path)).collect())
    want = sorted(tuple(line.split("\t")[:8]) for line in text.splitlines() if not line.startswith("#"))
    assert got == want
