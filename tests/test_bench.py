"""bench.py prints one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_REPEATS="1", BENCH_CPUS="2")
    proc = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                          text=True, timeout=900, check=True)
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(out)
    assert out["unit"] == "sec" and out["sf"] == 0.001
    assert abs(out["value"] - sum(out["queries"].values())) < 0.01
    assert {"variant_features", "full_variation_sequences", "ml_dataset", "etl_from_text", "score_report"} <= set(out["queries"])
    # the heavy end-to-end job runs last, so the state it leaves does not slow the others
    assert list(out["queries"])[-1] == "etl_from_text"
