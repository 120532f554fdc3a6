"""Readers: header TSV, VCF, FASTA and parquet; fixtures derived from driver tables."""
