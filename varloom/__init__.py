"""varloom — variant-dataset ETL and classifier evaluation as Spark DataFrame jobs.

Layout:

* ``sources``   — distributed readers (TSV, VCF, FASTA, parquet) and input fixtures;
* ``functions`` — Column expressions (name parsing, codes, vectors, scoring, hashing);
* ``operators`` — ``DataFrame -> DataFrame`` steps (filters, joins, dedupe, split,
  context aggregate, metrics, Spark ML fitting);
* ``plans``     — composite jobs, sinks and the command-line entry;
* ``llm`` — training-data operators, which nothing else imports.
"""

__version__ = "0.1.0"
