"""Scratch tables go to the session's shared checkpoint folder only."""

import pytest

from varloom.session import DEFAULT_CONF, build_session, clean_scratch, ensure_checkpoint_dir, shared_path, stage


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, current=None):
        self.master = master
        self.current = current
        self.applicationId = "app-1"

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = "file:" + path


class _Session:
    def __init__(self, master, conf=None, current=None):
        self.sparkContext = _Context(master, current)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_folder_is_used_as_is():
    session = _Session("yarn", {"spark.checkpoint.dir": "/shared/ckpt"})
    assert ensure_checkpoint_dir(session) == "file:/shared/ckpt"
    assert shared_path(session, "x").startswith("file:/shared/ckpt/varloom-app-1/x-")


def test_local_session_without_one_gets_a_local_folder():
    assert ensure_checkpoint_dir(_Session("local[2]")).startswith("file:/")


def test_real_session_uses_its_checkpoint_dir(spark):
    assert shared_path(spark, "y").startswith(spark.sparkContext.getCheckpointDir())


def test_file_folder_on_a_cluster_warns():
    with pytest.warns(UserWarning, match="share"):
        ensure_checkpoint_dir(_Session("yarn", {"spark.checkpoint.dir": "file:/mnt/shared"}))


def test_scratch_is_made_late_and_deleted(spark):
    import os

    path = stage(spark.range(3), "t").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    clean_scratch(spark)
    assert not os.path.exists(path)
    assert stage(spark.range(3), "t").count() == 3


def test_submitted_settings_win(spark):
    """Settings given at start-up stay; only the others get a default."""
    code = (
        "from varloom.session import build_session as b\n"
        "s = b(extra_conf={'spark.sql.adaptive.enabled': 'false'})\n"
        "print('GOT', s.conf.get('spark.sql.session.timeZone'), s.conf.get('spark.sql.adaptive.enabled'),\n"
        "      s.conf.get('spark.sql.adaptive.skewJoin.enabled'))\n"
    )
    import os
    import subprocess
    import sys

    from conftest import ROOT

    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": (
        "--master local[1] --conf spark.ui.enabled=false --conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell"
    )}
    said = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert "GOT Asia/Tokyo false true" in said.stdout, said.stderr[-500:]
    assert build_session() is not None and "spark.sql.session.timeZone" in DEFAULT_CONF
