from types import SimpleNamespace

import pytest

from promptsieve.sources import scratch as S
from promptsieve.sources.files import exists


def _session(master, setting=None, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, applicationId="app-1")
    return SimpleNamespace(conf={"spark.checkpoint.dir": setting}, sparkContext=context)


def test_shared_folder_is_asked_for(monkeypatch):
    monkeypatch.setattr(S.atexit, "register", lambda *_: None)
    with pytest.raises(ValueError, match="share"):
        S.scratch(_session("spark://host:7077"), "x")
    assert S.scratch(_session("spark://host:7077", "hdfs://a/b/"), "x").startswith("hdfs://a/b/promptsieve/app-1/x-")
    assert S.scratch(_session("yarn", None, "hdfs://c/d"), "x").startswith("hdfs://c/d/promptsieve/app-1/x-")
    assert S.scratch(_session("local[4]"), "x") != S.scratch(_session("local[4]"), "x")


def test_intermediate_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(S, "_OWN", set())
    monkeypatch.setattr(S.atexit, "register", lambda *_: None)
    monkeypatch.setattr(S, "scratch", lambda s, p, real=S.scratch: real(s, p).replace("/promptsieve/", "/promptsieve-test/"))
    kept = S.materialize(spark.range(3), "x")
    [file] = kept.limit(1).inputFiles()[:1]
    assert kept.count() == 3 and spark.sparkContext.applicationId in file
    [own] = S._OWN
    S._OWN.clear()
    S._OWN.add(own.replace("/promptsieve/", "/promptsieve-test/"))
    S.clear(spark)
    assert not exists(spark, file)
