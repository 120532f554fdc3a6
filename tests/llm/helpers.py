"""Small tables with the awkward rows every operator must take."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, alphabet=("alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa")):
    return " ".join(rng.choice(alphabet) + str(rng.randrange(40)) for _ in range(n))


def rows_of(texts, source="s"):
    return [(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, texts, extra=False):
    df = spark.createDataFrame(rows_of(texts), DOC)
    if extra:  # names that clash with what operators compute
        from pyspark.sql import functions as F

        for name in ("score", "kept", "size", "id", "key", "hits", "n", "pos", "line", "doc", "__text"):
            df = df.withColumn(name, F.lit("x"))
    return df


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared passages and lines, nulls, empties and a long one."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    line = "A line that many of the documents have in common, word for word."
    out = [None, "", " ", "one", "two words"]
    for _ in range(n):
        out.append("\n".join(prose(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 4))))
    for i in range(8, 14):
        out.append(out[i])
        out.append(out[i].replace("alpha", "omega", 1) if "alpha" in out[i] else out[i] + " tail")
        out.append(out[i] + "\n" + shared)
        out.append(out[i + 6] + "\n" + line)
        out.append(line[:-1] + "!\n" + out[i + 8])
    out.append(shared + "\n" + shared)
    out.append("ab " * 3000 + "end")
    return out
