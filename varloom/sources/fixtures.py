"""Input relations in the workload's schemas, derived from the driver's tables.

These only produce rows in the shape the jobs read (variant summary, VCF,
gene-accession map, protein FASTA, a scores table, a run-metrics table); they do
none of the jobs' work. Each column is a SQL expression that runs unchanged in
Spark and DuckDB, so the oracle side derives exactly the same input.
``{elem}`` marks the one engine-specific piece, 1-based array access.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.constants import AMINO_ACIDS

# The 22 three-letter codes in their fixed order, and the one-letter codes in the same order.
AA3 = "".join(AMINO_ACIDS)
AA1 = "".join(AMINO_ACIDS.values())


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_CDNA_POS = "(l_orderkey*7 + l_linenumber*131) % 60"
_PROT_POS = f"CASE WHEN l_suppkey % 13 = 0 THEN 2049 + l_orderkey % 300 ELSE 1 + {_CDNA_POS} END"
_PROT_ALT = (
    "CASE WHEN l_suppkey % 10 = 0 THEN '=' WHEN l_suppkey % 10 = 1 THEN 'Ter' "
    f"ELSE substr('{AA3}', CAST(1 + 3*(l_suppkey % 22) AS INT), 3) END"
)
_PROT_PART = (
    "CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE concat(' (p.', "
    f"substr('{AA3}', CAST(1 + 3*(l_partkey % 22) AS INT), 3), {_s(_PROT_POS)}, {_PROT_ALT}, ')') END"
)
_PHEN_A = f"concat('Phenotype ', {_s('l_suppkey % 7')})"
_PHEN_B = f"concat('Phenotype ', {_s('l_suppkey % 3')})"

VARIANT_SUMMARY = {
    "source": "lineitem",
    "columns": {
        "Name": (
            f"concat('NM_', lpad({_s('l_partkey % 500')}, 6, '0'), '.', {_s('1 + l_partkey % 3')}, "
            f"'(GENE', {_s('l_partkey % 500')}, '):c.', {_s(f'3*(1 + {_CDNA_POS})')}, 'A>G', {_PROT_PART})"
        ),
        "VariationID": _s("l_orderkey*10 + l_linenumber"),
        "GeneSymbol": f"concat('GENE', {_s('l_partkey % 500')})",
        "ClinSigSimple": "CASE WHEN l_returnflag = 'A' THEN '1' ELSE '0' END",
        "PhenotypeIDS": f"concat('MONDO:', {_s('l_suppkey % 7')})",
        "PhenotypeList": (
            f"CASE l_linenumber % 4 WHEN 0 THEN 'not provided' "
            f"WHEN 1 THEN concat({_PHEN_A}, '|not specified') "
            f"WHEN 2 THEN concat({_PHEN_A}, '|', {_PHEN_B}) "
            f"ELSE {_PHEN_B} END"
        ),
        "ReviewStatus": (
            "CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'no assertion criteria provided' "
            "WHEN 1 THEN 'reviewed by expert panel' WHEN 2 THEN 'practice guideline' "
            "ELSE 'criteria provided, single submitter' END"
        ),
        "Type": "CASE WHEN l_suppkey % 9 = 0 THEN 'Deletion' ELSE 'single nucleotide variant' END",
        "Assembly": "CASE WHEN l_orderkey % 6 = 0 THEN 'GRCh37' ELSE 'GRCh38' END",
        "ClinicalSignificance": (
            "CASE WHEN l_returnflag = 'A' THEN "
            "CASE WHEN l_linenumber % 2 = 0 THEN 'Pathogenic' ELSE 'Likely pathogenic' END "
            "WHEN l_returnflag = 'N' THEN "
            "CASE WHEN l_linenumber % 2 = 0 THEN 'Benign' ELSE 'Likely benign' END "
            "ELSE CASE WHEN l_linestatus = 'O' THEN 'Benign' ELSE 'Uncertain significance' END END"
        ),
    },
}

VCF = {
    "source": "lineitem",
    "columns": {
        "CHROM": _s("1 + l_orderkey % 22"),
        "POS": _s("100000 + l_orderkey*10 + l_linenumber"),
        "ID": _s("l_orderkey*10 + l_linenumber"),
        "REF": "'A'",
        "ALT": "'G'",
        "QUAL": "'.'",
        "FILTER": "'.'",
        "INFO": (
            f"concat('ALLELEID=', {_s('l_partkey')}, "
            "CASE l_suppkey % 4 WHEN 0 THEN '' "
            "WHEN 1 THEN ';MC=SO:0001627|intron_variant' "
            "WHEN 2 THEN ';MC=SO:0001583|missense_variant' "
            "ELSE ';MC=SO:0001627|intron_variant,SO:0001583|missense_variant' END, "
            "';ORIGIN=1')"
        ),
    },
}

GENE2ACCESSION = {
    "source": "part",
    "columns": {
        "#tax_id": "'9606'",
        "GeneID": _s("p_partkey % 500"),
        "status": (
            "CASE p_size % 4 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'VALIDATED' "
            "WHEN 2 THEN 'PROVISIONAL' ELSE 'MODEL' END"
        ),
        "RNA_nucleotide_accession.version": (
            f"concat('NM_', lpad({_s('p_partkey % 500')}, 6, '0'), '.', {_s('1 + p_partkey % 3')})"
        ),
        "protein_accession.version": (
            f"CASE WHEN p_size % 10 = 7 THEN '-' ELSE concat('NP_', lpad({_s('p_partkey % 500')}, 6, '0'), '.1') END"
        ),
    },
}

PROTEIN = {
    "source": "part",
    "distinct": True,
    "columns": {
        "id": (
            f"concat(CASE WHEN p_partkey % 5 = 4 THEN 'XP_' ELSE 'NP_' END, "
            f"lpad({_s('p_partkey % 500')}, 6, '0'), '.1')"
        ),
        "description": (
            f"concat('protein ', {_s('p_partkey % 500')}, "
            "CASE WHEN p_partkey % 500 % 7 = 0 THEN ' isoform a>b' ELSE '' END, ' [Homo sapiens]')"
        ),
        "sequence": f"repeat('{AA1}', CAST(2 + p_partkey % 500 % 90 AS INT))",
    },
}

SCORES = {
    "source": "embeddings",
    "generate": "m",
    "columns": {
        "key": _s("vec_id"),
        "model": f"concat('model_', {_s('m')})",
        "split": (
            "CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'val' ELSE 'test' END"
        ),
        "batch_id": "CAST(floor(vec_id / 256) AS INT)",
        "logit": "10 * CAST({elem} AS DOUBLE)",
        "label": "CAST(label % 2 AS INT)",
    },
    "elem": {"spark": "element_at(embedding, m)", "duckdb": "embedding[m]"},
}

RUNS = {
    "source": "events",
    "group": ("trial", "epoch"),
    "keys": {
        "trial": "CAST(user_id % 15 AS INT)",
        "epoch": "CAST(event_id % 10 AS INT)",
    },
    "aggregates": {"loss": "min(value)", "accuracy": "max(value)"},
}

RELATIONS = {
    "fx_variant_summary": VARIANT_SUMMARY,
    "fx_vcf": VCF,
    "fx_gene2accession": GENE2ACCESSION,
    "fx_protein": PROTEIN,
    "fx_scores": SCORES,
    "fx_runs": RUNS,
}

MODELS_PER_KEY = 4


def _quote(name: str, engine: str) -> str:
    if name.isidentifier():
        return name
    return f"`{name}`" if engine == "spark" else f'"{name}"'


def select_list(relation: dict, engine: str) -> list[str]:
    out = []
    if "aggregates" in relation:
        for name, expr in relation["keys"].items():
            out.append(f"{expr} AS {name}")
        for name, expr in relation["aggregates"].items():
            out.append(f"{expr} AS {name}")
        return out
    elem = relation.get("elem", {}).get(engine, "")
    for name, expr in relation["columns"].items():
        out.append(f"{expr.replace('{elem}', elem)} AS {_quote(name, engine)}")
    return out


def relation_sql(name: str, engine: str = "duckdb") -> str:
    """The relation as one SELECT over the driver table (DuckDB or Spark SQL)."""
    rel = RELATIONS[name]
    cols = ", ".join(select_list(rel, engine))
    source = rel["source"]
    if "generate" in rel:
        g = rel["generate"]
        if engine == "duckdb":
            source = f"(SELECT *, unnest(range(1, {MODELS_PER_KEY + 1})) AS {g} FROM {source})"
        else:
            source = f"(SELECT *, explode(sequence(1, {MODELS_PER_KEY})) AS {g} FROM {source})"
    distinct = "DISTINCT " if rel.get("distinct") else ""
    sql = f"SELECT {distinct}{cols} FROM {source}"
    if "group" in rel:
        sql += " GROUP BY " + ", ".join(rel["keys"].values())
    return sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a relation from the driver's parquet table with the DataFrame API."""
    rel = RELATIONS[name]
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{rel['source']}.parquet")
    if "generate" in rel:
        df = df.selectExpr("*", f"explode(sequence(1, {MODELS_PER_KEY})) AS {rel['generate']}")
    if "aggregates" in rel:
        from pyspark.sql import functions as F

        keyed = df.selectExpr("*", *[f"{e} AS {k}" for k, e in rel["keys"].items()])
        return keyed.groupBy(*rel["keys"]).agg(
            *[F.expr(e).alias(n) for n, e in rel["aggregates"].items()]
        )
    out = df.selectExpr(*select_list(rel, "spark"))
    return out.distinct() if rel.get("distinct") else out


def fixture_views_sql() -> str:
    """``WITH`` clause bodies defining every relation, for oracle SQL."""
    return ",\n".join(f"{n} AS ({relation_sql(n, 'duckdb')})" for n in RELATIONS)
