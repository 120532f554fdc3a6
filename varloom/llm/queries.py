"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import (
    centroids, chat, decontam, exact, lines, minhash, mixing, neighbours, quality, runs, substrings, toxicity, warc,
)
from varloom.llm.common import table
from varloom.llm.labelled import crc_remainder


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.shaped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", fixed), (-7, 1, "assistant", fixed)], turns.schema)
    back = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    lines_ = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines_, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select(
        "doc_id", "n_lines", "n_removed", "n_links",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(table(spark, sf_dir, "pages"))
    return history.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _repeating_tenth(docs: DataFrame) -> DataFrame:
    """The contract's input of op11: in every tenth document by hash, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    from_ = F.pmod(g, n)
    period = 1 + F.floor((n - from_) / (3 + F.pmod(g, F.lit(8))))
    # Bound as a lambda variable: the text is split once, not once a word.
    bound = F.array(F.struct(words.alias("w"), from_.cast("int").alias("a"), period.cast("int").alias("p")))

    def repeat(s: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(s["w"]) - 1)
        source = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))
        return F.array_join(F.transform(place, lambda i: F.get(s["w"], source(i))), " ")

    repeated = F.when(n > 0, F.transform(bound, repeat)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", F.when(h % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_repeating_tenth(table(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.array_min(ranked)).withColumn("longest", -F.col("best.less"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("longest").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * longest div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality, op3_neighbours, op4_decontamination, op5_mixing,
        op6_chat, op7_line_dedup, op8_near_duplicates, op9_warc, op10_toxicity,
        op11_periodic_runs, op12_exact_dedup, op13_centroid_clustering,
    )
}
