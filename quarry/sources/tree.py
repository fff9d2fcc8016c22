"""A data source that lists directory trees: one row per directory and per regular file.

Spark's own file listing hides names that start with a dot or an underscore and files without bytes, so trees are walked
by a Python source instead. Each top-level directory of a root is an input partition; ignore rules and skip lists prune
before descending. Symlinks are neither rows nor followed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources.decode import is_binary
from quarry.sources.ignore import IgnoreRules

# Directories that are dependencies or output even if no rule names them.
TREE_SKIP = ("node_modules", "vendor", "venv", ".venv", "dist", "target", "__pycache__")
CODE_SKIP = (*TREE_SKIP, "build")
# The greatest file that is parsed, and how much of a file tells whether it is binary or what it builds.
MOST_BYTES = 10 * 1024 * 1024
BINARY_PROBE = 8 * 1024
TEXT_PROBE = 32 * 1024
# Suffixes of files that make a directory named build a source directory.
BUILD_SOURCES = (
    ".py .pyi .pyw .js .mjs .cjs .jsx .ts .mts .cts .tsx .go .rs .java .kt .kts .rb .php .c .h .cpp .cc .cxx .hpp .hh .hxx .ps1 .psm1 .psd1 .sh .bash .zsh .fish .ksh .csh".split()
)

SCHEMA = "root_no int, root string, dir string, name string, fate string, size bigint, content binary"


class _Part(InputPartition):
    def __init__(self, root_no: int, root: str, top: str | None):
        self.root_no, self.root, self.top = root_no, root, top


class _Reader(DataSourceReader):
    """mode: tree (all files, their first bytes) or code (files worth parsing, whole)."""

    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.ignore = options.get("ignore", "true").lower() == "true"
        self.mode = options.get("mode", "tree")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for no, root in enumerate(self.roots):
            out.append(_Part(no, root, None))
            rules = self._rules(root)
            out += [_Part(no, root, name) for name, fate in self._dirs(root, "", rules) if fate == "enter"]
        return out

    def _rules(self, root: str) -> IgnoreRules | None:
        path = os.path.join(root, ".gitignore")
        return IgnoreRules.of_bytes(Path(path).read_bytes()) if self.ignore and os.path.isfile(path) else None

    def _dirs(self, root: str, rel: str, rules: IgnoreRules | None) -> list[tuple[str, str]]:
        """(name, enter | skip) of the directories below root/rel; omitted ones are not there."""
        out = []
        skip = TREE_SKIP if self.mode == "tree" else CODE_SKIP
        with os.scandir(os.path.join(root, rel)) as found:
            for e in sorted(found, key=lambda e: e.name):
                if not e.is_dir(follow_symlinks=False) or e.name == ".git":
                    continue
                path = f"{rel}/{e.name}" if rel else e.name
                if self.ignore and e.name in skip and not (e.name == "build" and self._holds_source(e.path)):
                    out.append((e.name, "skip"))
                elif rules is not None and rules.covers_dir(path):
                    continue
                else:
                    out.append((e.name, "enter"))
        return out

    @staticmethod
    def _holds_source(path: str) -> bool:
        try:
            return any(os.path.isfile(os.path.join(path, n)) and os.path.splitext(n.lower())[1] in BUILD_SOURCES for n in os.listdir(path))
        except OSError:
            return False

    def read(self, part: _Part) -> Iterator[tuple]:
        rules = self._rules(part.root)
        if part.top is None:
            yield part.root_no, part.root, "", None, "enter", None, None
            yield from self._files(part, "", rules)
            for name, fate in self._dirs(part.root, "", rules):
                if fate == "skip":
                    yield part.root_no, part.root, name, None, "skip", None, None
            return
        todo = [part.top]
        while todo:
            rel = todo.pop()
            yield part.root_no, part.root, rel, None, "enter", None, None
            yield from self._files(part, rel, rules)
            try:
                inner = self._dirs(part.root, rel, rules)
            except OSError:
                continue
            for name, fate in inner:
                if fate == "skip":
                    yield part.root_no, part.root, f"{rel}/{name}", None, "skip", None, None
                else:
                    todo.append(f"{rel}/{name}")

    def _files(self, part: _Part, rel: str, rules: IgnoreRules | None) -> Iterator[tuple]:
        try:
            names = sorted(os.listdir(os.path.join(part.root, rel)))
        except OSError:
            return
        for name in names:
            full, path = os.path.join(part.root, rel, name), f"{rel}/{name}" if rel else name
            if os.path.islink(full) or not os.path.isfile(full) or rules is not None and rules.matches(path):
                continue
            size = os.path.getsize(full)
            content = None
            if self.mode == "tree":
                try:
                    with open(full, "rb") as f:
                        content = f.read(TEXT_PROBE)
                except OSError:
                    pass
            else:
                if size > MOST_BYTES:
                    continue
                content = Path(full).read_bytes()
                if is_binary(content[:BINARY_PROBE]):
                    continue
            yield part.root_no, part.root, rel, name, "file", size, content


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, roots: list[str], ignore: bool = True, mode: str = "tree") -> DataFrame:
    """Rows of SCHEMA: directories (name null, fate enter or skip) and files."""
    if not roots:
        raise ValueError("at least one root is needed")
    for r in roots:
        if not os.path.isdir(r):
            raise NotADirectoryError(r)
    spark.dataSource.register(TreeSource)
    return spark.read.format("quarry_tree").option("roots", json.dumps([os.path.realpath(r) for r in roots])).option("ignore", str(ignore).lower()).option("mode", mode).load()
