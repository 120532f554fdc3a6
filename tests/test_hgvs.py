"""Name parsing: the six patterns on representative HGVS names."""


from varloom.functions.hgvs import with_name_parts

CASES = [
    ("NM_000059.4(BRCA2):c.1234A>G (p.Lys412Arg)", ("NM_000059.4", "BRCA2", "Lys412Arg", "Lys", "412", "Arg")),
    ("NM_1.2(G1):c.10+5G>A", ("NM_1.2", "G1", "", "", "", "")),
    ("NM_1.2(G1):c.30C>T (p.Phe10=)", ("NM_1.2", "G1", "Phe10", "Phe", "10", "")),
    ("NM_1.2(G1):c.30C>T (p.Arg10Ter)", ("NM_1.2", "G1", "Arg10Ter", "Arg", "10", "Ter")),
    ("NM_1.2(G1):c.1A>G (p.Met1?)", ("NM_1.2", "G1", "Met1", "Met", "1", "")),
    ("NM_1.2:c.5A>G (p.Sec7Cys)", ("NM_1.2:c.5A>G ", "p.Sec7Cys", "Sec7Cys", "Sec", "7", "Cys")),
    ("no parens", ("", "", "", "", "", "")),
    (None, (None, None, None, None, None, None)),
]

PARTS = ["transcription", "gene", "SNV", "REF", "POS", "ALT"]


def test_name_parts_table(spark):
    df = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(CASES)], "i int, Name string")
    got = {r["i"]: tuple(r[p] for p in PARTS) for r in with_name_parts(df).collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[i] == expected, CASES[i][0]


def test_name_parts_single_projection_of_protein_change(spark):
    df = spark.createDataFrame([("NM_1.2(G1):c.30C>T (p.Arg10Ter)",)], "Name string")
    plan = with_name_parts(df)._jdf.queryExecution().optimizedPlan().toString()
    # The protein-change regex is evaluated once; the last three parts read its result.
    assert plan.count("p\\.([A-Za-z0-9]+)") == 1
