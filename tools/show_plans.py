"""Print the executed physical plans of the headline jobs as Markdown.

Usage: python tools/show_plans.py [sf_dir] > PLANS.md

Broadcast joins are switched off so the plans show the shape they take when
no side is small (the large-data case); adaptive execution stays on.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "Aggregate", "Scan", "Window", "Generate", "Sort ", "WriteFiles", "Expand",
        "Python", "InMemory", "AQEShuffleRead", "ReusedExchange", "Filter", "Project")


def _compact(plan: str) -> str:
    final = plan.split("== Initial Plan ==")[0]
    out = []
    for line in final.split("\n"):
        if not any(k in line for k in KEEP):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: [^,]+, ", "", line)
        out.append(line.rstrip()[:170])
    return "\n".join(out)


def main():
    from pyspark.sql import functions as F

    from varloom.functions.vectors import join_ints
    from varloom.operators import context as ctx_ops
    from varloom.operators import metrics
    from varloom.plans import jobs, sinks
    from varloom.plans import queries as q
    from varloom.session import build_session, stage

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")

    parts = stage(jobs.ml_parts(q._full(spark, sf)), "plan_rows")
    width = sinks.dense_partitions(parts.count())
    shown = {
        "JOB1 variant features (input relation from lineitem)": q.variant_features(spark, sf),
        "JOB2 missense ids": q.missense_ids(spark, sf),
        "JOB5 full variation dataset with sequences": q.full_variation_sequences(spark, sf),
        "JOB6 context on the staged split rows, one group-key partitioning, dense vectors": sinks.with_dense_vectors(
            ctx_ops.context_positions(parts, partitions=width)
        ),
        "JOB6 context, within-split scope, no width given": ctx_ops.context_positions(parts).withColumn(
            "context_positions", join_ints(F.col("context_positions"))
        ),
        "JOB7 score report per (model, split)": metrics.report(
            metrics.score_rows(q._fx(spark, sf, "fx_scores")), by=["model", "split"]
        ),
    }
    print("# Physical plans of the headline jobs\n")
    print("Generated by `python tools/show_plans.py`: planned physical operators (exchanges, joins, aggregates,")
    print("scans with their pushed filters and read schemas), with broadcast joins switched off to show the shape")
    print("when no side is small. Expression ids are stripped. The `DISTINCT` over `id, description, sequence`")
    print("belongs to the protein input relation; every other exchange is the job's own.\n")
    for title, df in shown.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {title}\n")
        print(f"Exchanges: {plan.count('Exchange hashpartitioning') + plan.count('Exchange rangepartitioning')}\n")
        print("```")
        print(_compact(plan))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
