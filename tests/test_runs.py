"""Whole runs over folders of frames, as calls and as jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import SparkSession

from glyphstream import jobs as J
from glyphstream import runs, session
from glyphstream.config import Config
from glyphstream.operators import detectors
from glyphstream.operators.engine import Request
from glyphstream.sources import events_json
from tests import decoders
from tests.test_engine import scene


@pytest.fixture
def folder(tmp_path):
    t = np.arange(0, 12, 0.5)
    np.savez(tmp_path / "4.npz", t=t, image=np.stack([scene(seed=1 + int(x >= 6)) for x in t]))
    return str(tmp_path)


def test_run_and_its_metadata(spark, folder, tmp_path):
    o = runs.Options(sample_fps=0, chunk_sec=4.0, overlap_sec=1.0, regions=((0.9, 0.9, 1.0, 1.0),))
    made = runs.run_folder(spark, folder, str(tmp_path / "out"), decoders.detector, decoders.recognizer, options=o)
    about = json.loads((tmp_path / "out" / "metadata.json").read_text())
    assert made.event_count == 2 == spark.read.parquet(made.events).count() and about["profile"]["output_events"] == 2
    assert about["options"]["chunk_sec"] == 4.0 and about["strategy"] == "given" and about["profile"]["chunk_count"] >= 3 and made.to_dict()["video_realtime"] > 0
    whole = runs.run_folder(spark, folder, str(tmp_path / "whole"), decoders.detector, decoders.recognizer, options=runs.Options(sample_fps=0))
    texts = lambda r: sorted(x.text for x in spark.read.parquet(r.events).collect())
    assert texts(whole) == texts(made) and whole.profile["chunk_count"] == 1
    for bad in ({"start_sec": -1}, {"start_sec": 3, "end_sec": 2}, {"chunk_sec": -1}):
        with pytest.raises(ValueError):
            runs.Options(**bad).check()


def test_runs_as_jobs(spark, folder, tmp_path):
    jobs = J.Jobs(spark, str(tmp_path / "jobs"))
    tools = runs.Tools(jobs)
    names = folder, "tests.decoders:detector", "tests.decoders:recognizer"
    made = [tools.run(*names), tools.run_chunked(*names, chunk_sec=10.0), tools.segment(*names, start_sec=7.0, end_sec=9.0), tools.benchmark(*names, configs={"one": Config(), "two": Config()})]
    jobs.close()
    assert [(j.kind, j.status, j.error) for j in made] == [(k, "completed", None) for k in ("run", "chunked", "segment", "benchmark")]
    assert jobs.status(made[2].job_id).rows == 1 and [r["name"] for r in jobs.page(made[3].job_id, ["name"])[0]] == ["one", "two"]
    with pytest.raises(ValueError):
        tools.run_chunked(*names, chunk_sec=0)
    with pytest.raises(ValueError):
        tools.benchmark(*names, configs={})
    jobs.clean_up(made[0].job_id, confirm=True)
    assert not (tmp_path / "jobs" / made[0].job_id).exists()


def test_command_line(spark, folder, tmp_path, capsys):
    from glyphstream.__main__ import main

    args = [folder, str(tmp_path / "cli"), "--detector", "tests.decoders:detector", "--recognizer", "tests.decoders:recognizer", "--sample-fps", "2", "--end-sec", "5", "--exclude", "0.9,0.9,1,1"]
    assert main(["run", *args]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["event_count"] == 1


def test_what_lies_below_a_root():
    assert J.within("/a/b/c", "/a/b") and J.within("hdfs://x/a/b", "hdfs://x/a")
    assert not J.within("/a/b", "/a/b") and not J.within("/a/bc/d", "/a/b") and not J.within("/a/b/../c", "/a/b")


def test_json_of_values(spark, tmp_path):
    assert json.loads(json.dumps({"a": np.arange(3), "b": np.float64(0.5), "c": Config()}, default=events_json.plain))["a"] == [0, 1, 2]
    with pytest.raises(TypeError):
        json.dumps(object(), default=events_json.plain)
    events_json.write_metadata(spark, f"file://{tmp_path}/deep/m.json", {"x": "é"})
    assert json.loads((tmp_path / "deep" / "m.json").read_text()) == {"x": "é"}


def test_model_detectors_scale_and_unscale():
    image = np.zeros((200, 400), np.uint8)
    d = detectors.model_detector(decoders.model)
    (box, score), = d(image, Request("FAST", "probe", 100))
    assert box == (100.0, 50.0, 300.0, 150.0) and score == 0.35
    found = d(image, Request("LOCAL", "change", 100, scopes=((40.0, 20.0, 80.0, 60.0), (-5.0, 0.0, 395.0, 10.0))))
    assert found[0] == ((50.0, 30.0, 70.0, 50.0), 0.28) and len(found) == 2
    assert d(image, Request("AUDIT", "audit", 2560, excluded=((0.0, 0.0, 400.0, 200.0),))) == []
    assert decoders.model.made == 1


def test_clusters_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="share"):
        session.use_checkpoint_dir(Session())
    assert SparkSession.getActiveSession() is None or True
