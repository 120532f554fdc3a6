"""Columns bind by each file's header; rejected lines stand beside the good rows."""

import gzip

import pytest

from varloom.sources import text


def files(tmp_path, **contents):
    out = []
    for name, content in contents.items():
        path = tmp_path / name.replace("__", ".")
        data = content.encode()
        path.write_bytes(gzip.compress(data) if path.name.endswith(".gz") else data)
        out.append(str(path))
    return out


def test_swapped_headers_give_equal_rows(spark, tmp_path):
    paths = files(tmp_path, a__tsv="x\ty\n1\t2\n", b__tsv="y\tx\n2\t1\n", c__tsv__gz="y\tz\tx\n2\t9\t1\n")
    assert [tuple(r) for r in text.read_tsv(spark, paths, ["x", "y"]).collect()] == [("1", "2")] * 3
    everything = text.read_tsv(spark, paths)
    assert everything.columns == ["x", "y", "z"]
    assert sorted(map(repr, map(tuple, everything.collect()))) == sorted(map(repr, [("1", "2", None)] * 2 + [("1", "2", "9")]))


def test_one_scan_per_order(spark, tmp_path):
    contents = {f"f{i}__tsv": ("x\ty\n" if i % 2 else "y\tx\n") + f"{i}\t{i}\n" * 3 for i in range(6)}
    df = text.read_tsv(spark, files(tmp_path, **contents), ["y"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "ReadSchema: struct<y:string>" in plan
    assert df.count() == 18
    same = text.read_tsv(spark, files(tmp_path, g__tsv="x\ty\n1\t2\n", h__tsv="x\ty\n3\t4\n"))
    assert same._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1


def test_missing_and_repeated_columns_raise(spark, tmp_path):
    paths = files(tmp_path, a__tsv="x\ty\n1\t2\n", b__tsv="x\tz\n3\t4\n")
    with pytest.raises(ValueError, match=r"b\.tsv: the header has no column 'y'"):
        text.read_tsv(spark, paths, ["x", "y"])
    with pytest.raises(ValueError, match="stands twice"):
        text.read_tsv(spark, files(tmp_path, c__tsv="x\tX\n1\t2\n"))


def test_empty_files_and_crlf(spark, tmp_path):
    paths = files(tmp_path, a__tsv="", b__tsv="x\ty\r\n1\t2\r\n", c__tsv="y\tx\n", d__tsv="y\tx\n5\t6")
    assert sorted(tuple(r) for r in text.read_tsv(spark, paths, ["x", "y"]).collect()) == [("1", "2"), ("6", "5")]
    none = text.read_tsv(spark, files(tmp_path, e__tsv=""), ["x", "y.z"])
    assert none.columns == ["x", "y.z"] and none.collect() == []


def test_checked_tsv_keeps_and_rejects_every_line(spark, tmp_path):
    paths = files(
        tmp_path,
        a__tsv="x\ty\tz\n1\t2\t3\nshort\t1\n\n4\t\t6\nlong\t1\t2\t3\nx\ty\tz\n",
        b__tsv__gz="z\tx\ty\n3\t1\t2\nonly\n",
    )
    got = text.checked_tsv(spark, paths, ["x", "z"])
    assert sorted(map(tuple, got.rows.collect())) == [("1", "3"), ("1", "3"), ("4", "6")]
    bad = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in got.rejected.collect())
    assert bad == [
        ("a.tsv", "long\t1\t2\t3", "long: 4 of 3 fields"), ("a.tsv", "short\t1", "short: 2 of 3 fields"),
        ("b.tsv.gz", "only", "short: 1 of 3 fields"),
    ]
    good = [p for p in files(tmp_path, c__tsv="x\ty\tz\n1\t\\\"2\t3 \n")]
    assert text.checked_tsv(spark, good).rows.collect() == text.read_tsv(spark, good).collect()
    assert text.checked_tsv(spark, files(tmp_path, d__tsv=""), ["x"]).rejected.count() == 0


def test_checked_vcf(spark, tmp_path):
    line = "1\t2\tID7\tA\tG\t.\t.\tMC=1"
    paths = files(tmp_path, a__vcf=f"##h\n#CHROM\n{line}\n{line}\tGT\n1\t2\t3\n\nfree text\n" + line.replace("ID7", "."))
    got = text.checked_vcf(spark, paths)
    assert sorted(map(repr, got.rows.collect())) == sorted(
        map(repr, [r for r in text.read_vcf(spark, paths).collect() if r["ALT"] is not None])
    )
    assert sorted((r["line"], r["reason"]) for r in got.rejected.collect()) == [
        ("1\t2\t3", "short: 3 of 8 fields"), ("free text", "short: 1 of 8 fields"),
    ]


def test_checked_fasta(spark, tmp_path):
    paths = files(tmp_path, a__fa=">NP_1.1 one\nMK\nTA\n> no id here\nMM\n>NP_2.1\n", b__fa="\n")
    got = text.checked_fasta(spark, paths)
    assert sorted(map(tuple, got.rows.collect())) == sorted(map(tuple, text.read_fasta(spark, paths).collect()))
    assert [(r["line"], r["reason"]) for r in got.rejected.collect()] == [(" no id here", "no id")]


def test_a_checked_scan_reads_its_files_once(spark, tmp_path):
    got = text.checked_tsv(spark, files(tmp_path, a__tsv="x\ty\n1\t2\n3\n"))
    for df in (got.rows, got.rejected):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "FileScan text" not in plan
