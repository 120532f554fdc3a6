"""Fixed values of the variant workload.

Everything in the block below must equal the values the original ETL uses, or
results differ. They are stated plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original workload exactly)
# ---------------------------------------------------------------------------

# Three-letter amino-acid codes and their one-letter codes, 22 entries.
AMINO_ACIDS: dict[str, str] = {
    "Ala": "A",
    "Ile": "I",
    "Arg": "R",
    "Leu": "L",
    "Asn": "N",
    "Lys": "K",
    "Asp": "D",
    "Met": "M",
    "Asx": "B",
    "Phe": "F",
    "Cys": "C",
    "Pro": "P",
    "Gln": "Q",
    "Ser": "S",
    "Glu": "E",
    "Thr": "T",
    "Glx": "Z",
    "Trp": "W",
    "Gly": "G",
    "Tyr": "Y",
    "His": "H",
    "Val": "V",
}

# Variant-summary row filter.
VARIANT_TYPE = "single nucleotide variant"
VARIANT_ASSEMBLY = "GRCh38"
VARIANT_REVIEW_STATUSES = (
    "criteria provided, single submitter",
    "reviewed by expert panel",
    "practice guideline",
)
VARIANT_CLINICAL_SIGNIFICANCES = (
    "Pathogenic",
    "Likely pathogenic",
    "Benign",
    "Likely benign",
)

# Width of the mutation and context vectors; positions above it are dropped.
MAX_SEQUENCE_LENGTH = 2048
# Width the model scripts expect for each of the two vectors.
MODEL_VECTOR_LENGTH = 2056

# Regular expressions applied to the HGVS variant name, in this order.
NAME_TRANSCRIPT_RE = r"^([^()]+)\("
NAME_GENE_RE = r"\(([^)]+)\)"
NAME_PROTEIN_CHANGE_RE = r"p\.([A-Za-z0-9]+)"
CHANGE_REF_RE = r"^([A-Za-z]+)"
CHANGE_POS_RE = r"([0-9]+)"
CHANGE_ALT_RE = r"([A-Za-z]+)$"

# VCF molecular-consequence key and the term that marks a missense variant.
VCF_CONSEQUENCE_KEY = "MC"
MISSENSE_TERM = "missense_variant"

# Gene-accession map: accepted statuses and the missing-value sentinel.
ACCESSION_STATUSES = ("REVIEWED", "VALIDATED")
ACCESSION_MISSING = "-"

# Protein FASTA records kept by the main run.
PROTEIN_PREFIX = "NP_"

# Phenotype values that carry no phenotype.
PHENOTYPE_PLACEHOLDERS = ("not provided", "not specified")
PHENOTYPE_SEPARATOR = "|"

# Splits.
SPLIT_RATIOS = (0.70, 0.15, 0.15)
SPLIT_NAMES = ("train", "val", "test")
SPLIT_SEED = 42
TWO_WAY_RATIOS = (0.80, 0.20)
TWO_WAY_NAMES = ("train", "val")

# Scoring.
SCORE_BATCH_SIZE = 256
DECISION_THRESHOLD = 0.5

# Hyper-parameter search: budget, iterations and hidden layer shapes to draw from.
SEARCH_TRIALS = 15
SEARCH_ITERATIONS = (8, 10, 12)
# Learning rates are drawn log-uniformly between these.
SEARCH_STEP_SIZES = (1e-5, 1e-2)
SEARCH_HIDDEN_LAYERS = ((512, 256, 128), (1024, 512, 128), (256, 128, 64))

# The full variation table: published column name and the column it comes from, in order.
FULL_VARIATION_SOURCES = (
    ("name", "Name"),
    ("gene_symbol", "GeneSymbol"),
    ("phenotype_ids", "PhenotypeIDS"),
    ("phenotype_list", "PhenotypeList"),
    ("NM_transcript", "transcription"),
    ("NP_transcript", "NP_transcript"),
    ("REF_amino_acid", "REF"),
    ("ALT_amino_acid", "ALT"),
    ("position", "POS"),
    ("is_pathogenic", "ClinSigSimple"),
)
# Of these, the columns translated to one-letter residue codes.
RESIDUE_COLUMNS = ("REF_amino_acid", "ALT_amino_acid")

# ---------------------------------------------------------------------------
# Column contracts
# ---------------------------------------------------------------------------

VARIANT_SUMMARY_COLUMNS = (
    "Name",
    "VariationID",
    "GeneSymbol",
    "ClinSigSimple",
    "PhenotypeIDS",
    "PhenotypeList",
    "ReviewStatus",
)
VARIANT_FILTER_COLUMNS = ("Type", "Assembly", "ClinicalSignificance")

VCF_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")

ACCESSION_STATUS_COL = "status"
ACCESSION_RNA_COL = "RNA_nucleotide_accession.version"
ACCESSION_PROTEIN_COL = "protein_accession.version"

ML_KEY_COLUMNS = ("NP_transcript", "position", "phenotype_list")
ML_BASE_COLUMNS = ("name", "NP_transcript", "position", "phenotype_list", "is_pathogenic")

# Model-side names for the two vectors and the label.
MODEL_SIDE_NAMES = {
    "mutation_vector": "POS_vector",
    "context_vector": "Patho_Vector",
    "is_pathogenic": "ClinSigSimple",
}
