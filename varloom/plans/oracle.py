"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code (window ``row_number`` dedupe,
correlated subqueries for the context, list functions for the VCF filter), over
the same input relations. The fixed values come from ``varloom.constants``.
"""

from __future__ import annotations

from varloom.constants import (
    AMINO_ACIDS,
    MAX_SEQUENCE_LENGTH,
    MODEL_VECTOR_LENGTH,
    PHENOTYPE_PLACEHOLDERS,
    SEARCH_TRIALS,
    VARIANT_ASSEMBLY,
    VARIANT_CLINICAL_SIGNIFICANCES,
    VARIANT_REVIEW_STATUSES,
    VARIANT_TYPE,
)
from varloom.sources import fixtures
from varloom.sources.fixtures import fixture_views_sql


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def _codes(col: str) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in AMINO_ACIDS.items())
    return f"CASE {col} {whens} ELSE {col} END"


N = MAX_SEQUENCE_LENGTH
W = MODEL_VECTOR_LENGTH
SNV_RE = r"p\.([A-Za-z0-9]+)"

STEPS = f"""
vs_filtered AS (
  SELECT * FROM fx_variant_summary
  WHERE Type = {_lit(VARIANT_TYPE)} AND Assembly = {_lit(VARIANT_ASSEMBLY)}
    AND ReviewStatus IN {_in(VARIANT_REVIEW_STATUSES)}
    AND ClinicalSignificance IN {_in(VARIANT_CLINICAL_SIGNIFICANCES)}
),
vs_one AS (
  SELECT Name, VariationID, GeneSymbol, ClinSigSimple, PhenotypeIDS, PhenotypeList, ReviewStatus FROM (
    SELECT *, row_number() OVER (
      PARTITION BY VariationID
      ORDER BY Name NULLS FIRST, PhenotypeList NULLS FIRST, PhenotypeIDS NULLS FIRST,
               ReviewStatus NULLS FIRST, ClinSigSimple NULLS FIRST, GeneSymbol NULLS FIRST) AS rn
    FROM (SELECT Name, VariationID, GeneSymbol, TRY_CAST(ClinSigSimple AS INTEGER) AS ClinSigSimple,
                 PhenotypeIDS, PhenotypeList, ReviewStatus FROM vs_filtered)
  ) WHERE rn = 1
),
features AS (
  SELECT *,
    regexp_extract(SNV, '^([A-Za-z]+)', 1) AS REF,
    regexp_extract(SNV, '([0-9]+)', 1) AS POS,
    regexp_extract(SNV, '([A-Za-z]+)$', 1) AS ALT
  FROM (SELECT *,
      regexp_extract(Name, '^([^()]+)\\(', 1) AS transcription,
      regexp_extract(Name, '\\(([^)]+)\\)', 1) AS gene,
      regexp_extract(Name, '{SNV_RE}', 1) AS SNV
    FROM vs_one)
),
mids AS (
  SELECT ID AS VariationID FROM fx_vcf
  WHERE coalesce(len(list_filter(
      string_split(regexp_extract(';' || INFO, ';MC=([^;]*)', 1), ','),
      lambda m: contains(m, 'missense_variant'))) > 0, false)
),
tmap AS (
  SELECT DISTINCT "RNA_nucleotide_accession.version" AS NM_transcript,
                  "protein_accession.version" AS NP_transcript
  FROM fx_gene2accession
  WHERE status IN ('REVIEWED', 'VALIDATED')
    AND "RNA_nucleotide_accession.version" <> '-' AND "protein_accession.version" <> '-'
),
seqs AS (SELECT id, sequence FROM fx_protein WHERE starts_with(id, 'NP_')),
mvars AS (SELECT * FROM features WHERE VariationID IN (SELECT VariationID FROM mids)),
mapped AS (
  SELECT f.*, t.NM_transcript, t.NP_transcript FROM mvars f JOIN tmap t ON f.transcription = t.NM_transcript
),
full_var AS (
  SELECT Name AS name, GeneSymbol AS gene_symbol, PhenotypeIDS AS phenotype_ids,
         PhenotypeList AS phenotype_list, transcription AS NM_transcript, NP_transcript,
         {_codes('REF')} AS REF_amino_acid, {_codes('ALT')} AS ALT_amino_acid,
         POS AS position, ClinSigSimple AS is_pathogenic
  FROM mapped WHERE VariationID IS NOT NULL AND VariationID <> '' AND SNV <> ''
),
ph_rows AS (
  SELECT name, NP_transcript, position, ph AS phenotype_list, is_pathogenic FROM (
    SELECT name, NP_transcript, position, unnest(string_split(phenotype_list, '|')) AS ph, is_pathogenic
    FROM full_var)
  WHERE TRY_CAST(position AS INTEGER) BETWEEN 1 AND {N}
    AND ph IS NOT NULL AND ph NOT IN {_in(PHENOTYPE_PLACEHOLDERS)}
),
ph_one AS (
  SELECT name, NP_transcript, position, phenotype_list, is_pathogenic FROM (
    SELECT *, row_number() OVER (PARTITION BY NP_transcript, position, phenotype_list
                                 ORDER BY name NULLS FIRST, is_pathogenic NULLS FIRST) AS rn
    FROM ph_rows) WHERE rn = 1
),
splits AS (
  SELECT name, NP_transcript, position, phenotype_list, is_pathogenic,
         CASE WHEN b < 700 THEN 'train' WHEN b < 850 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '42', NP_transcript, position, phenotype_list)), 1, 8))
                       AS BIGINT) % 1000 AS b FROM ph_one)
),
scored AS (
  SELECT *,
    CASE WHEN 1.0 / (1.0 + exp(-logit)) > 0.5 THEN 1 ELSE 0 END AS predicted,
    CASE WHEN (CASE WHEN 1.0 / (1.0 + exp(-logit)) > 0.5 THEN 1 ELSE 0 END) = label THEN 1 ELSE 0 END AS correct,
    greatest(logit, 0.0) - logit * label + ln(1 + exp(-abs(logit))) AS loss
  FROM fx_scores
)
"""


def _with(select: str) -> str:
    return f"WITH {fixture_views_sql()},\n{STEPS.strip()}\n{select}"


_BATCH = """(row_number() OVER (PARTITION BY split ORDER BY
  md5(concat_ws('|', '42', 'shuffle', NP_transcript, position, phenotype_list)), NP_transcript, position, phenotype_list) - 1) // 256"""
_STATED_LOGIT = f"""((37 * (TRY_CAST(position AS INTEGER) - 1)) % 101 - 50
  + coalesce(list_sum(list_transform(lst, lambda c: (37 * ({N} + c - 1)) % 101 - 50)), 0)) / 100.0::DOUBLE"""
_SUMMARY = list(fixtures.VARIANT_SUMMARY["columns"])
_VCF = list(fixtures.VCF["columns"])
_DAMAGED = f"""
damaged AS (
  SELECT 'variant_summary' AS input, CASE VariationID::BIGINT % 17
      WHEN 0 THEN concat_ws(chr(9), {", ".join(_SUMMARY[:-3])})
      WHEN 1 THEN concat_ws(chr(9), {", ".join(_SUMMARY)}, 'extra') END AS line,
    CASE VariationID::BIGINT % 17 WHEN 0 THEN 'short: {len(_SUMMARY) - 3} of {len(_SUMMARY)} fields'
      WHEN 1 THEN 'long: {len(_SUMMARY) + 1} of {len(_SUMMARY)} fields' END AS reason
  FROM fx_variant_summary
  UNION ALL
  SELECT 'vcf', concat_ws(chr(9), {", ".join(_VCF[:5])}),
    CASE WHEN POS::BIGINT % 19 = 0 THEN 'short: 5 of {len(_VCF)} fields' END
  FROM fx_vcf
  UNION ALL
  SELECT 'protein', ' ' || description, CASE WHEN length(sequence) % 5 = 0 THEN 'no id' END FROM fx_protein
)"""


def _context_sql(scope: str, keep_list: bool = False) -> str:
    if scope == "within_split":
        match = "o.split = r.split AND "
    else:
        match = "o.split = 'train' AND "
    extra = ", lst" if keep_list else ""
    return f"""
SELECT name, NP_transcript, position, phenotype_list, is_pathogenic, split,
       coalesce(array_to_string(lst, ','), '') AS context_positions,
       CAST(coalesce(len(lst), 0) AS BIGINT) AS n_context{extra}
FROM (
  SELECT r.*, (
    SELECT list_sort(list(DISTINCT TRY_CAST(o.position AS INTEGER))) FROM splits o
    WHERE {match}o.NP_transcript = r.NP_transcript AND o.phenotype_list = r.phenotype_list
      AND o.is_pathogenic = 1 AND o.position <> r.position
  ) AS lst
  FROM splits r
)"""


# Dense vectors as strings of N digits: one-hot at the position; multi-hot at the context list.
_ONE_HOT = f"(repeat('0', TRY_CAST(position AS INTEGER) - 1) || '1' || repeat('0', {N} - TRY_CAST(position AS INTEGER)))"
_MULTI_HOT = (
    f"array_to_string(list_transform(range(1, {N} + 1), "
    "lambda i: CASE WHEN coalesce(list_contains(lst, i), false) THEN '1' ELSE '0' END), '')"
)

_REPORT = """round(100.0::DOUBLE * sum(correct) / count(*), 6) AS accuracy,
  round(avg(loss), 6) AS mean_loss"""

_LAST = """last_res AS (
  SELECT r.trial, r.epoch, r.loss, r.accuracy FROM fx_runs r
  JOIN (SELECT trial, max(epoch) AS e FROM fx_runs GROUP BY trial) l ON r.trial = l.trial AND r.epoch = l.e
)"""

_ML_TABLE = f"""
SELECT name, NP_transcript, position, phenotype_list, is_pathogenic, split,
       TRY_CAST(position AS INTEGER) AS mutation_position,
       context_positions AS context_hot
FROM ({_context_sql('within_split')})"""

ORACLE: dict[str, str] = {
    "scan_variant_summary": _with("SELECT * FROM fx_variant_summary"),
    "scan_vcf": _with("SELECT * FROM fx_vcf"),
    "scan_vcf_blocks": _with("SELECT * FROM fx_vcf"),
    "scan_variant_summary_orders": _with("SELECT * FROM fx_variant_summary"),
    "rejected_rows": _with(f", {_DAMAGED} SELECT input, line, reason FROM damaged WHERE reason IS NOT NULL"),
    "rejected_counts": _with(
        f""", {_DAMAGED} SELECT input, count(*) AS n_read, count(*) FILTER (reason IS NULL) AS n_kept, count(reason) AS n_rejected
        FROM damaged GROUP BY input"""
    ),
    "scan_gene2accession": _with(
        'SELECT "#tax_id" AS tax_id, GeneID AS gene_id, status, '
        '"RNA_nucleotide_accession.version" AS rna_accession, '
        '"protein_accession.version" AS protein_accession FROM fx_gene2accession'
    ),
    "scan_fasta": _with("SELECT id, description, sequence FROM fx_protein"),
    "protein_sequences": _with("SELECT id, sequence FROM seqs"),
    "protein_sequence_count": _with("SELECT count(*) AS n_sequences FROM seqs"),
    "variant_filter": _with("SELECT * FROM vs_filtered"),
    "variant_features": _with("SELECT * FROM features"),
    "hgvs_parts": _with(
        f"""SELECT VariationID, Name, transcription, gene, SNV,
              regexp_extract(SNV, '^([A-Za-z]+)', 1) AS REF,
              regexp_extract(SNV, '([0-9]+)', 1) AS POS,
              regexp_extract(SNV, '([A-Za-z]+)$', 1) AS ALT
            FROM (SELECT VariationID, Name,
                    regexp_extract(Name, '^([^()]+)\\(', 1) AS transcription,
                    regexp_extract(Name, '\\(([^)]+)\\)', 1) AS gene,
                    regexp_extract(Name, '{SNV_RE}', 1) AS SNV
                  FROM fx_variant_summary)"""
    ),
    "missense_ids": _with("SELECT VariationID FROM mids"),
    "missense_id_counts": _with(
        "SELECT count(*) AS n_ids, count(DISTINCT VariationID) AS n_distinct_ids FROM mids"
    ),
    "duplicate_ids": _with(
        "SELECT VariationID, count(*) AS n FROM mids GROUP BY VariationID HAVING count(*) > 1"
    ),
    "transcript_map": _with("SELECT * FROM tmap"),
    "missense_variants": _with("SELECT * FROM mvars"),
    "mapped_variants": _with("SELECT * FROM mapped"),
    "unmapped_variants": _with(
        "SELECT * FROM mvars f WHERE NOT EXISTS (SELECT 1 FROM tmap t WHERE t.NM_transcript = f.transcription)"
    ),
    "amino_acid_codes": _with(
        f"SELECT DISTINCT REF, ALT, {_codes('REF')} AS REF_amino_acid, {_codes('ALT')} AS ALT_amino_acid FROM features"
    ),
    "full_variation": _with("SELECT * FROM full_var"),
    "full_variation_sequences": _with(
        """SELECT f.* EXCLUDE (p), s.sequence,
             CASE WHEN p >= 1 THEN substring(s.sequence, 1, p - 1) || f.ALT_amino_acid
                                   || substring(s.sequence, p + 1, length(s.sequence)) END AS mutated_sequence,
             coalesce(CASE WHEN p >= 1 THEN substring(s.sequence, p, 1) END = f.REF_amino_acid, false) AS ref_matches
           FROM (SELECT *, TRY_CAST(position AS INTEGER) AS p FROM full_var) f
           JOIN seqs s ON f.NP_transcript = s.id"""
    ),
    "unsequenced_variants": _with(
        "SELECT * FROM full_var f WHERE NOT EXISTS (SELECT 1 FROM seqs s WHERE s.id = f.NP_transcript)"
    ),
    "phenotype_rows": _with("SELECT * FROM ph_rows"),
    "phenotype_dedupe": _with("SELECT * FROM ph_one"),
    "split_assign": _with("SELECT * FROM splits"),
    "split_two_way": _with(
        """SELECT name, NP_transcript, position, phenotype_list, is_pathogenic, split,
             CASE WHEN b < 800 THEN 'train' ELSE 'val' END AS fit_split
           FROM (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '42', 'fit', NP_transcript, position,
                                phenotype_list)), 1, 8)) AS BIGINT) % 1000 AS b
                 FROM splits WHERE split = 'train')"""
    ),
    "shuffled_rows": _with(
        """SELECT *, md5(concat_ws('|', '42', 'shuffle', NP_transcript, position, phenotype_list)) AS shuffle_key
           FROM ph_one"""
    ),
    "context_within_split": _with(_context_sql("within_split")),
    "context_from_train": _with(_context_sql("from_train")),
    "mutation_vector": _with(
        f"""SELECT NP_transcript, position, phenotype_list, CAST({N} AS BIGINT) AS mutation_len,
              {_ONE_HOT} AS mutation_bits
            FROM ph_one"""
    ),
    "context_vector": _with(
        f"""SELECT NP_transcript, position, phenotype_list, split, CAST({N} AS BIGINT) AS context_len,
              {_MULTI_HOT} AS context_bits
            FROM ({_context_sql('within_split', keep_list=True)})"""
    ),
    "ml_table": _with(_ML_TABLE),
    "feature_projection": _with(
        f"""SELECT position, context_positions, is_pathogenic
            FROM ({_context_sql('within_split')}) WHERE split = 'test'"""
    ),
    "two_channel_input": _with(
        f"""SELECT NP_transcript, position, phenotype_list, split, CAST(2 AS BIGINT) AS n_channels,
              CAST({N} AS BIGINT) AS width, {_ONE_HOT} AS channel0_bits, {_MULTI_HOT} AS channel1_bits
            FROM ({_context_sql('within_split', keep_list=True)})"""
    ),
    "full_variation_preview": _with(
        """SELECT * FROM full_var
           ORDER BY name NULLS FIRST, gene_symbol NULLS FIRST, phenotype_ids NULLS FIRST,
                    phenotype_list NULLS FIRST, NM_transcript NULLS FIRST, NP_transcript NULLS FIRST,
                    REF_amino_acid NULLS FIRST, ALT_amino_acid NULLS FIRST, position NULLS FIRST,
                    is_pathogenic NULLS FIRST
           LIMIT 20"""
    ),
    "ml_table_dense": _with(
        f"""SELECT name, NP_transcript, position, phenotype_list, is_pathogenic, split,
              CAST({N} AS BIGINT) AS mutation_len, {_ONE_HOT} AS mutation_bits,
              CAST({N} AS BIGINT) AS context_len, {_MULTI_HOT} AS context_bits
            FROM ({_context_sql('within_split', keep_list=True)})"""
    ),
    "model_side_table": _with(
        f"""SELECT NP_transcript, position, phenotype_list, split,
              CAST({W} AS BIGINT) AS POS_len, {_ONE_HOT} || repeat('0', {W - N}) AS POS_vector,
              CAST({W} AS BIGINT) AS Patho_len, {_MULTI_HOT} || repeat('0', {W - N}) AS Patho_Vector,
              is_pathogenic AS ClinSigSimple
            FROM ({_context_sql('within_split', keep_list=True)})"""
    ),
    "fit_logistic": _with(
        """SELECT split, count(*) AS n, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS base_loss,
             CASE WHEN split = 'train' THEN true END AS train_loss_at_most_base
           FROM (SELECT split, avg(is_pathogenic) OVER (PARTITION BY split) AS p FROM splits)
           GROUP BY split, p"""
    ),
    "search_best": _with(
        f"""SELECT CAST({SEARCH_TRIALS} AS BIGINT) AS n_trials, count(*) AS n_validation, CAST(1 AS BIGINT) AS n_best,
             true AS best_is_lowest
           FROM (SELECT CAST(('0x' || substr(md5(concat_ws('|', '42', 'fit', NP_transcript, position,
                             phenotype_list)), 1, 8)) AS BIGINT) % 1000 AS b
                 FROM splits WHERE split = 'train') WHERE b >= 800"""
    ),
    "fixed_weights_scores": _with(
        f"""SELECT NP_transcript, position, phenotype_list, split, CAST({2 * N} AS BIGINT) AS width,
              {_STATED_LOGIT} AS logit
            FROM ({_context_sql('within_split', keep_list=True)})"""
    ),
    "global_batches": _with(f"SELECT NP_transcript, position, phenotype_list, split, {_BATCH} AS batch_id FROM splits"),
    "global_batch_mean_loss": _with(
        f"""SELECT split, count(*) AS n_batches, round(avg(l), 6) AS batch_mean_loss, round(sum(s) / sum(n), 6) AS row_mean_loss
        FROM (SELECT split, batch_id, avg(loss) AS l, sum(loss) AS s, count(*) AS n
              FROM (SELECT split, {_BATCH} AS batch_id,
                      greatest(logit, 0.0) - logit * is_pathogenic + ln(1 + exp(-abs(logit))) AS loss
                    FROM (SELECT *, {_STATED_LOGIT} AS logit FROM ({_context_sql('within_split', keep_list=True)})))
              GROUP BY split, batch_id) GROUP BY split"""
    ),
    "split_by_protein": _with(
        """, g AS (SELECT NP_transcript AS k, count(*) AS n, md5(concat_ws('|', '42', 'balanced', NP_transcript)) AS h FROM ph_one GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY n DESC, h, k) AS i, sum(n) OVER () AS total FROM g),
        deal AS (
          SELECT 0::BIGINT AS i, 0::BIGINT AS n, 0 AS p, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c
          UNION ALL
          SELECT i, n, p, a + CASE p WHEN 1 THEN n ELSE 0 END, b + CASE p WHEN 2 THEN n ELSE 0 END, c + CASE p WHEN 3 THEN n ELSE 0 END
          FROM (SELECT o.i, o.n, d.a, d.b, d.c,
                  CASE WHEN 70 * total - 100 * a >= 15 * total - 100 * least(b, c) THEN 1 WHEN b <= c THEN 2 ELSE 3 END AS p
                FROM deal d JOIN o ON o.i = d.i + 1)
        ),
        q AS (SELECT n, count(*) FILTER (p = 1) AS m1, count(*) FILTER (p = 2) AS m2 FROM deal WHERE i > 0 GROUP BY n),
        r AS (SELECT k, n, row_number() OVER (PARTITION BY n ORDER BY h, k) AS j FROM g)
        SELECT NP_transcript, position, phenotype_list,
          CASE WHEN j <= m1 THEN 'train' WHEN j <= m1 + m2 THEN 'val' ELSE 'test' END AS split
        FROM ph_one JOIN r ON r.k = NP_transcript JOIN q ON q.n = r.n"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "epoch_metrics": "SELECT 0 AS trial, 4::BIGINT AS n_epochs, 4::BIGINT AS n_rows, true AS best_is_lowest, true AS reloaded_model_has_it",
    "halving_rungs": """SELECT * FROM (VALUES (0, 15::BIGINT, 1, true), (1, 4::BIGINT, 4, true), (2, 1::BIGINT, 16, true))
        AS t(rung, n_trials, n_epochs, replay_agrees)""",
    "pass_counts": _with(
        """, early AS (SELECT * FROM vs_filtered WHERE VariationID IN (SELECT VariationID FROM mids))
        SELECT 'summary_rows' AS step, count(*) AS n FROM fx_variant_summary
        UNION ALL SELECT 'filtered_rows', count(*) FROM vs_filtered
        UNION ALL SELECT 'missense_rows', count(*) FROM early
        UNION ALL SELECT 'variants', count(*) FROM mvars
        UNION ALL SELECT 'no_transcript', count(*) FROM mvars WHERE transcription = ''
        UNION ALL SELECT 'unmapped_variants', count(*) FROM mvars
          WHERE transcription <> '' AND transcription NOT IN (SELECT NM_transcript FROM tmap)
        UNION ALL SELECT 'mapped_rows', count(*) FROM mapped
        UNION ALL SELECT 'full_rows', count(*) FROM full_var
        UNION ALL SELECT 'unsequenced_rows', count(*) FROM full_var WHERE NP_transcript NOT IN (SELECT id FROM seqs)
        UNION ALL SELECT 'written_rows', count(*) FROM full_var JOIN seqs ON id = NP_transcript"""
    ),
    "missense_features": _with("SELECT * FROM mvars"),
    "context_bucketed": _with(
        _context_sql("within_split").replace("FROM splits", "FROM (SELECT * FROM splits WHERE NP_transcript IN (SELECT id FROM seqs))")
    ),
    "published_sequences": _with("SELECT id, sequence FROM seqs"),
    "score_rows": _with(
        "SELECT key, model, split, batch_id, label, round(logit, 6) AS logit, predicted, correct, "
        "round(loss, 6) AS loss FROM scored"
    ),
    "model_report": _with(
        f"SELECT model, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct, {_REPORT} "
        "FROM scored GROUP BY model"
    ),
    "model_split_report": _with(
        f"SELECT model, split, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct, {_REPORT} "
        "FROM scored GROUP BY model, split"
    ),
    "batch_mean_loss": _with(
        """SELECT b.model, b.n_batches, round(b.bml, 6) AS batch_mean_loss, round(r.rml, 6) AS row_mean_loss
           FROM (SELECT model, count(*) AS n_batches, avg(bl) AS bml
                 FROM (SELECT model, batch_id, avg(loss) AS bl FROM scored GROUP BY model, batch_id)
                 GROUP BY model) b
           JOIN (SELECT model, avg(loss) AS rml FROM scored GROUP BY model) r ON b.model = r.model"""
    ),
    "best_epoch": _with(
        """SELECT m.trial,
             (SELECT min(r.epoch) FROM fx_runs r WHERE r.trial = m.trial AND r.loss = m.best_loss) AS best_epoch,
             m.best_loss, m.n_epochs
           FROM (SELECT trial, min(loss) AS best_loss, count(*) AS n_epochs
                 FROM fx_runs WHERE loss IS NOT NULL GROUP BY trial) m"""
    ),
    "best_trial": _with(
        f""", {_LAST}
        SELECT trial, epoch, loss, accuracy FROM last_res ORDER BY loss ASC NULLS LAST, trial LIMIT 1"""
    ),
    "best_trial_accuracy": _with(
        f""", {_LAST}
        SELECT trial, epoch, loss, accuracy FROM last_res ORDER BY accuracy DESC NULLS LAST, trial LIMIT 1"""
    ),
}
