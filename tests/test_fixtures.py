"""Fixture queries against the rows that their SQL states, and what the command line does with a model."""

import sys
import types

import duckdb
import pytest

from quarry import registry
from quarry.cli import main
from quarry.plans import cascade, fixture_trees, fixtures  # noqa: F401


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.startswith("fixture_")])
def test_rows_as_stated(spark, name):
    rows = registry.QUERIES[name](spark, "")
    want = duckdb.connect().execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(tuple, rows.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_no_model_without_its_name_or_its_client(monkeypatch):
    assert cascade.provider({}) is None and cascade.provider({"QUARRY_MODEL": " "}) is None
    monkeypatch.setitem(sys.modules, "litellm", None)
    assert cascade.provider({"QUARRY_MODEL": "m"}) is None


def test_the_command_line_asks_the_model_once(spark, plant, tmp_path, monkeypatch, capsys):
    calls = []

    def completion(**given):
        calls.append(given)
        names = [line.split("\t") for line in given["messages"][0]["content"].splitlines() if "\t" in line]
        import json

        text = json.dumps({"results": [{"module": m, "symbol": s, "io": True, "kinds": ["service"]} for m, s in names]})
        return types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content=text))])

    monkeypatch.setitem(sys.modules, "litellm", types.SimpleNamespace(completion=completion))
    monkeypatch.setenv("QUARRY_MODEL", "m")
    monkeypatch.setenv("QUARRY_API_BASE", "http://b")
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "x"))
    root = plant({"a.py": "import depot\ndepot.send()\n"}, "tree")
    for more, asked in (([], 1), ([], 1), (["--refresh"], 2), (["--cache", f"file://{tmp_path}/other"], 3)):
        assert main(["io", root, *more], spark) == 0
        assert len(calls) == asked and capsys.readouterr().out == "a.py\n  service  python  depot.send  2\n"
    assert (calls[0]["model"], calls[0]["api_base"], calls[0]["timeout"], calls[0]["max_retries"]) == ("m", "http://b", 60, 0)
    with pytest.raises(SystemExit):
        main(["io", root, "--jobs", "0"], spark)


def test_a_cache_of_many_files_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cascade, "MANY_FILES", 3)
    cache = cascade.LabelCache(spark, f"file://{tmp_path}/c")
    cache.compact()
    for i in range(5):
        cache.put("m", "python", {("a", "x"): (i % 2 == 0, ["network"][: i % 2 == 0]), ("a", f"y{i}"): (False, [])})
    before = sorted(map(tuple, cache.rows().select("module", "symbol", "io").collect()))
    cache.compact()
    assert sorted(map(tuple, cache.rows().select("module", "symbol", "io").collect())) == before == [("a", "x", True), *(("a", f"y{i}", False) for i in range(5))]
    assert len(list((tmp_path / "c").glob("part-*"))) <= 4
