"""Readers on real text files: VCF, FASTA, TSV, gzip."""

import gzip


from varloom.operators.missense import missense_ids
from varloom.sources import text


def _write(path, content, gz=False):
    data = content.encode()
    if gz:
        with gzip.open(path, "wb") as f:
            f.write(data)
    else:
        with open(path, "wb") as f:
            f.write(data)
    return path


VCF = (
    "##fileformat=VCFv4.1\n"
    "##INFO=<ID=MC,Number=.,Type=String>\n"
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    "1\t10\t101\tA\tG\t.\t.\tALLELEID=1;MC=SO:1|missense_variant,SO:2|x\n"
    "1\t11\t102\tA\tG\t.\t.\tMC=SO:1|missense_variant\n"
    "1\t12\t103\tA\tG\t.\t.\tXMC=SO:1|missense_variant;A\n"
    "1\t13\t104\tA\tG\t.\t.\tFLAG\n"
    "1\t14\t105\tA\tG\t.\t.\t.\n"
    "1\t15\t106\tA\tG\t.\t.\tMC=SO:1|intron_variant;MC=SO:2|missense_variant\n"
    "1\t16\t107\tA\tG\t.\t.\tMC=SO:1|synonymous_variant,SO:1|missense_variant;ORIGIN=1\tGT\t0/1\n"
)


def test_vcf_missense_ids(spark, tmp_path):
    path = _write(str(tmp_path / "a.vcf"), VCF)
    vcf = text.read_vcf(spark, path)
    assert vcf.count() == 7  # comment and header lines skipped
    ids = sorted(r[0] for r in missense_ids(vcf).collect())
    # 106: the first MC entry is intron only (first key wins, repeated keys do not fail)
    assert ids == ["101", "102", "107"]


def test_vcf_gzip_equals_plain(spark, tmp_path):
    plain = _write(str(tmp_path / "a.vcf"), VCF)
    gz = _write(str(tmp_path / "b.vcf.gz"), VCF, gz=True)
    a = sorted(map(tuple, text.read_vcf(spark, plain).collect()))
    b = sorted(map(tuple, text.read_vcf(spark, gz).collect()))
    assert a == b


FASTA = (
    ">NP_000001.1 first protein isoform a>b [Homo sapiens]\n"
    "MKTAYIAKQR\n"
    "QISFVKSHFS\n"
    ">XP_000002.1 predicted\n"
    "MAAA\n"
    ">NP_000003.2\n"
    "MC\n"
    "DE\n"
)


def _fasta_rows(spark, path):
    return {r["id"]: (r["description"], r["sequence"]) for r in text.read_fasta(spark, path).collect()}


def test_fasta_records(spark, tmp_path):
    rows = _fasta_rows(spark, _write(str(tmp_path / "p.faa"), FASTA))
    assert rows == {
        "NP_000001.1": ("first protein isoform a>b [Homo sapiens]", "MKTAYIAKQRQISFVKSHFS"),
        "XP_000002.1": ("predicted", "MAAA"),
        "NP_000003.2": ("", "MCDE"),
    }


def test_fasta_gzip_and_crlf(spark, tmp_path):
    plain = _fasta_rows(spark, _write(str(tmp_path / "p.faa"), FASTA))
    gz = _fasta_rows(spark, _write(str(tmp_path / "p.faa.gz"), FASTA, gz=True))
    crlf = _fasta_rows(spark, _write(str(tmp_path / "c.faa"), FASTA.replace("\n", "\r\n")))
    assert gz == plain
    assert crlf == plain


def test_fasta_prefix_filter(spark, tmp_path):
    from varloom.plans.jobs import protein_sequences_frame

    path = _write(str(tmp_path / "p.faa"), FASTA)
    ids = sorted(r["id"] for r in protein_sequences_frame(text.read_fasta(spark, path)).collect())
    assert ids == ["NP_000001.1", "NP_000003.2"]


def test_tsv_quotes_are_literal_and_columns_bind_by_name(spark, tmp_path):
    content = "b\ta\tc\n" 'x"y\t1\tz\n' '"q\t2\tw\n'
    path = _write(str(tmp_path / "t.tsv"), content)
    rows = text.read_tsv(spark, path, columns=["a", "b", "c"]).collect()
    got = sorted((r["a"], r["b"], r["c"]) for r in rows)
    assert got == [("1", 'x"y', "z"), ("2", '"q', "w")]


def test_tsv_dotted_header_names(spark, tmp_path):
    from varloom.operators.mapping import transcript_map

    content = (
        "#tax_id\tstatus\tRNA_nucleotide_accession.version\tprotein_accession.version\n"
        "9606\tREVIEWED\tNM_1.1\tNP_1.1\n"
        "9606\tVALIDATED\tNM_1.1\tNP_1.1\n"
        "9606\tMODEL\tNM_2.1\tNP_2.1\n"
        "9606\tREVIEWED\tNM_3.1\t-\n"
        "9606\tVALIDATED\tNM_4.1\tNP_4.1\n"
    )
    path = _write(str(tmp_path / "g.tsv"), content)
    got = sorted(map(tuple, transcript_map(text.read_tsv(spark, path)).collect()))
    assert got == [("NM_1.1", "NP_1.1"), ("NM_4.1", "NP_4.1")]


def test_tsv_gzip_equals_plain(spark, tmp_path):
    content = "Name\tVariationID\n" + "".join(f"N{i}\t{i}\n" for i in range(50))
    plain = _write(str(tmp_path / "v.txt"), content)
    gz = _write(str(tmp_path / "v.txt.gz"), content, gz=True)
    a = sorted(map(tuple, text.read_tsv(spark, plain).collect()))
    b = sorted(map(tuple, text.read_tsv(spark, gz).collect()))
    assert a == b and len(a) == 50


def test_tsv_mixed_plain_and_gzip_files(spark, tmp_path):
    header = "Name\tVariationID\n"
    a = _write(str(tmp_path / "a.txt"), header + "".join(f"A{i}\t{i}\n" for i in range(30)))
    b = _write(str(tmp_path / "b.txt.gz"), header + "".join(f"B{i}\t{100 + i}\n" for i in range(20)), gz=True)
    rows = text.read_tsv(spark, [a, b], columns=["VariationID"]).collect()
    assert sorted(int(r[0]) for r in rows) == list(range(30)) + list(range(100, 120))


def test_names_without_a_codec_raise(spark, tmp_path):
    import pytest

    _write(str(tmp_path / "d" / "a.vcf.bgz") if (tmp_path / "d").mkdir() is None else "", VCF, gz=True)
    for path in (str(tmp_path / "d" / "a.vcf.bgz"), str(tmp_path / "d")):
        with pytest.raises(ValueError, match="rename"):
            text.read_vcf(spark, path)


def test_a_folder_of_gzip_files_is_spread(spark, tmp_path):
    (tmp_path / "g").mkdir()
    _write(str(tmp_path / "g" / "a.vcf.gz"), VCF, gz=True)
    one = text.read_vcf(spark, str(tmp_path / "g" / "a.vcf.gz"))
    folder = text.read_vcf(spark, str(tmp_path / "g"))
    width = spark.sparkContext.defaultParallelism
    for df in (one, folder):
        assert f"Exchange RoundRobinPartitioning({width})" in df._jdf.queryExecution().executedPlan().toString()


def test_a_vcf_dot_is_no_id(spark, tmp_path):
    lines = "#CHROM\n1\t5\t.\tA\tG\t.\t.\tMC=SO:1|missense_variant\n1\t6\t77\tA\tG\t.\t.\tMC=SO:1|missense_variant\n"
    vcf = text.read_vcf(spark, _write(str(tmp_path / "x.vcf"), lines))
    assert sorted((r["ID"] or "", r["QUAL"]) for r in vcf.collect()) == [("", "."), ("77", ".")]
