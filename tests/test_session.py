"""Where tables between steps are put."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from parcella.session import shared_dir


def session(master, **settings):
    option = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master=master, getConf=lambda: settings, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)), setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=settings)


def test_the_shared_folder_is_the_one_that_is_set():
    assert shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"


def test_a_temporary_folder_is_for_local_sessions_only():
    assert shared_dir(session("local[4]")).startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
