"""One version of all tables of a run, published by one manifest.

A versioned run writes its tables into a folder of its own, ``<root>/runs/<run id>``. When
all are written, a manifest that names them is put under ``<root>/_manifests`` with the
next number: written beside and renamed, so it is there whole or not at all. Readers follow
the highest manifest, so they see the tables of one run together; a run that fails before
its manifest changes nothing for them. ``expire`` deletes the run folders that none of the
last manifests names.

A path ``<root>#<table>`` names a table of the current version (:func:`resolve`).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from varloom.session import delete_path

MANIFESTS, RUNS = "_manifests", "runs"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, folder: str) -> list[str]:
    system, target = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def begin(root: str, run_id: str | None = None) -> tuple[str, str]:
    """(run id, folder) for a new run's tables. Nothing is written yet."""
    run_id = run_id or uuid.uuid4().hex[:12]
    return run_id, f"{root.rstrip('/')}/{RUNS}/{run_id}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, ascending."""
    names = _names(spark, f"{root.rstrip('/')}/{MANIFESTS}")
    return [int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0].isdigit()]


def _manifest_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{MANIFESTS}/{version:010d}.json"


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, str]) -> int:
    """Make the run's tables (name to path) the current version; returns its number.

    Every table must be complete (its ``_SUCCESS`` file is there). Two runs that publish at
    once get numbers one after the other, where a rename refuses an existing target (HDFS).
    """
    for name, path in tables.items():
        system, target = _file_system(spark, f"{path}/_SUCCESS")
        if not system.exists(target):
            raise FileNotFoundError(f"table {name} of run {run_id} is not complete: {path}")
    text = json.dumps({"run": run_id, "tables": tables}, sort_keys=True)
    system, beside = _file_system(spark, f"{root.rstrip('/')}/{MANIFESTS}/.{run_id}-{uuid.uuid4().hex[:8]}")
    out = system.create(beside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    while True:
        version = max(versions(spark, root), default=0) + 1
        _, target = _file_system(spark, _manifest_path(root, version))
        if not system.exists(target) and system.rename(beside, target):
            return version


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """``run`` and ``tables`` of a version (the current one without a number); None where nothing is published."""
    known = versions(spark, root)
    if version is None and not known:
        return None
    path = _manifest_path(root, known[-1] if version is None else version)
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def table_path(spark: SparkSession, root: str, name: str, version: int | None = None) -> str:
    """Where a table of the version lies."""
    found = manifest(spark, root, version)
    if found is None or name not in found["tables"]:
        raise LookupError(f"{root}: no published table {name}")
    return found["tables"][name]


def resolve(spark: SparkSession, path: str) -> str:
    """``<root>#<table>`` as the current version's path; any other path as it is."""
    root, mark, name = path.rpartition("#")
    return table_path(spark, root, name) if mark else path


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete older manifests and the run folders that the last ``keep`` do not name; returns the deleted run ids.

    A run that is still writing has no manifest yet: call this when none is.
    """
    if keep < 1:
        raise ValueError("keep at least the current version")
    known = versions(spark, root)
    kept = {manifest(spark, root, v)["run"] for v in known[-keep:]}
    gone = [r for r in _names(spark, f"{root.rstrip('/')}/{RUNS}") if r not in kept]
    for version in known[:-keep]:
        delete_path(spark, _manifest_path(root, version))
    for run_id in gone:
        delete_path(spark, f"{root.rstrip('/')}/{RUNS}/{run_id}")
    return gone
