"""Column expressions: built-in Spark functions only, evaluated in the JVM."""

from varloom.functions import amino, hashing, hgvs, scoring, sequence, vectors

__all__ = ["amino", "hashing", "hgvs", "scoring", "sequence", "vectors"]
