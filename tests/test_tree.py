import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.functions.fileclass import classify, is_named_build
from quarry.plans.fixtures import BAKERY
from quarry.plans.tree_report import scan_tree
from quarry.sources.ignore import IgnoreRules

BAKERY_TEXT = """\
go.work
Makefile
other ×1
.hooks/  ci.yml  rules
deploy/  image/cake  play.yaml  pods.json  stack.yml  1 file  other ×1  1 dir  depth 1
ovens/  3 files  Go ×2  Rust ×1  2 dirs  depth 1
shop/
  till/
    pyproject.toml
    Python ×1
    tests/  1 file  Python ×1  2 dirs  depth 2
  window/  1 file  other ×1
"""


def test_abstract(spark, plant, capsys):
    report = scan_tree(spark, plant(BAKERY))
    assert report.to_text() == BAKERY_TEXT
    assert "walk\nwalk 17\n" in capsys.readouterr().err
    tree = json.loads(report.to_json())["roots"][0]["tree"]
    assert tree["markers"] == ["go.work"] and tree["path"] == ""
    assert next(c for c in tree["collapsed"] if c["path"] == "ovens") == {"path": "ovens", "build": [], "files": {"Go": 2, "Rust": 1}, "file_count": 3, "directories": 2, "depth": 1}
    assert [c["path"] for c in tree["children"]] == ["shop"] and tree["children"][0]["children"][0]["path"] == "shop/till"


def test_several_roots_of_one_name(spark, plant):
    first, second = plant({"a.c": ""}, "src"), plant({"b.KTS": "", "c.": ""}, "deep/src")
    report = scan_tree(spark, first, second, first)
    assert report.names == ["src", "src-2"]
    assert report.to_text() == f"{first}\nC ×1\n\n{second}\nKotlin ×1  other ×1\n"


def test_skips_and_rules(spark, plant):
    root = plant({".gitignore": "*.tmp\nprivate/\n!keep.tmp\n", "x.tmp": "", "keep.tmp": "", "private/n.md": "n", ".git/config": "c", "dist/b.js": "", "build/Gemfile": "", "app/target/x": "", "app/build/m.rb": "", "mod/__init__.py": "", "mod/M.psd1": "ModuleVersion = 1", "ps/D.PSD1": "@{}"})
    os.symlink(f"{root}/keep.tmp", f"{root}/also.py")
    os.mkdir(f"{root}/hollow")
    text = scan_tree(spark, root).to_text()
    assert text == "other ×2\ndist/  skipped\napp/  1 file  Ruby ×1  2 dirs  depth 1\nbuild/\n  Gemfile\nhollow/\nmod/\n  M.psd1\n  Python ×1\nps/  1 file  PowerShell ×1\n"
    everything = scan_tree(spark, root, ignore=False).to_text()
    assert "dist/  1 file  JavaScript ×1" in everything and "private/  1 file  other ×1" in everything and ".git/" not in everything


@pytest.mark.parametrize(
    "name, text, kind",
    [
        ("x.yml", "a: 1\nservices:\n  web:\n    image: n\n", "build"), ("x.yml", "services: none\n", "file"), ("x.yaml", " on: x\n jobs: y\n", "file"), ("x.json", '{"type": "Microsoft.Web"}', "build"), ("x.json", '{"a": 1}', "file"),
        ("x.md", "FROM a\nRUN b\n", "file"), ("noext", "define a\nb\nendef\n", "build"), ("noext", ".PHONY: all\n", "build"), ("noext", "FROM a\rRUN b\n", "file"), ("noext", "FROM a\nRUN b\0", "file"), ("Dockerfile.dev", "", "build"),
        ("main.tf.json", "{}", "build"), ("a.csproj", "", "marker"), ("Gemfile.lock", "", "file"), ("x.yml", "\u2028on: a\n\x0cjobs: b\n", "build"),
    ],
)
def test_file_classes(spark, name, text, kind):
    row = spark.createDataFrame([(name, bytearray(text, "utf-8"))], "name string, head binary")
    assert row.select(classify(F.col("name"), F.col("name"), F.col("head"))[0].alias("k")).first().k == kind


def test_circle_config_at_any_depth(spark):
    rows = spark.createDataFrame([(".circleci/config.yml",), ("a/.circleci/config.yml",), ("a/circleci/config.yml",)], "p string")
    assert [r.b for r in rows.select(is_named_build(F.lit("config.yml"), F.col("p")).alias("b")).collect()] == [True, True, False]


@pytest.mark.parametrize(
    "rules, path, hit",
    [
        (["*.log"], "a/b.log", True), (["/a.txt"], "b/a.txt", False), (["/a.txt"], "a.txt", True), (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True), (["**/foo"], "x/foo", True),
        (["*.log", "!keep.log"], "keep.log", False), (["tmp/"], "tmp", False), (["tmp/"], "tmp/x", True), (["a?c"], "abc", True), (["[ab].py"], "c.py", False), (["#x", ""], "#x", False), (["doc/*.txt"], "doc/a/b.txt", False),
    ],
)
def test_ignore_rules(rules, path, hit):
    assert IgnoreRules(rules).matches(path) is hit


def test_missing_root(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        scan_tree(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        scan_tree(spark)
