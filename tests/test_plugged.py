"""Engines as a data source."""

import json



import pytest

from chronoloom.sources import engines, plugged


def load(spark, path, **options):
    spark.dataSource.register(plugged.EngineSource)
    r = spark.read.format("engine")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(str(path))


def test_artifacts_equal_the_importers(spark, tmp_path):
    tokens = [[{"text": "[_BEG]", "p": 0.1}, {"text": "a", "p": 0.5}, {"text": "b", "p": 0.25}], [], [{"text": "[_X]", "p": 1.0}]]
    for i in range(5):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "a.json").write_text(json.dumps({"transcription": [{"offsets": {"from": i, "to": i + 5}, "text": f"é{j}", "tokens": x} for j, x in enumerate(tokens)]}))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.json").write_text("no")
    got = load(spark, tmp_path, engine="recognised", kind="recognised", suffix=".json", per_task="2")
    assert got.rdd.getNumPartitions() == 3
    plain = engines.recognised(spark, str(tmp_path) + "/r*/*.json")
    row = lambda r: (r.ord, r.start_ms, r.end_ms, r.text, r.confidence)
    key = lambda x: (x[1], x[0])
    assert sorted(map(row, got.collect()), key=key) == sorted(map(row, plain.collect()), key=key)


def test_planning_fails_before_anything_is_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = tmp_path / "out"
    for options, why in (({"engine": "recognised", "kind": "x"}, "one of"), ({"engine": "nobody", "kind": "recognised"}, "neither one"), ({"engine": "recognised", "kind": "recognised"}, "no recordings"), ({"engine": "json:loads", "kind": "recognised"}, "")):
        with pytest.raises(Exception, match=why):
            load(spark, tmp_path / "in", **options).write.parquet(str(out))
        assert not out.exists()


def test_an_engine_of_ones_own(spark, tmp_path, monkeypatch):
    """Any module on the workers' path may bring an engine; its preflight speaks in planning."""
    (tmp_path / "own_engine.py").write_text(
        "class Loud:\n    def preflight(self):\n        pass\n    def read(self, uri):\n        yield from [(0, 10, uri[-5:], None), (10, 20, 'two', 0.5)]\n"
        "class Gone(Loud):\n    def preflight(self):\n        raise RuntimeError('model file is missing')\n"
    )
    (tmp_path / "a.wav").write_bytes(b"1")
    (tmp_path / "b.wav").write_bytes(b"2")
    spark.sparkContext.addPyFile(str(tmp_path / "own_engine.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    got = load(spark, tmp_path, engine="own_engine:Loud", kind="recognised", suffix=".wav")
    assert sorted((r.text, r.ord, r.confidence) for r in got.collect()) == [("a.wav", 0, None), ("b.wav", 0, None), ("two", 1, 0.5), ("two", 1, 0.5)]
    with pytest.raises(Exception, match="model file is missing"):
        load(spark, tmp_path, engine="own_engine:Gone", kind="recognised", suffix=".wav").collect()
