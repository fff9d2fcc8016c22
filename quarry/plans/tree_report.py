"""The directory abstract as text and JSON. Only the summary's rows come to the driver."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quarry.operators.tree import classified, summarize
from quarry.sources.tree import read_tree


def root_names(roots: list[str]) -> list[str]:
    """Empty for a single root; else directory names, repeated ones numbered."""
    if len(roots) < 2:
        return [""] * len(roots)
    seen: dict[str, int] = {}
    out = []
    for r in roots:
        name = os.path.basename(r)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}-{seen[name]}")
    return out


def _counts(files) -> str:
    return "  ".join(f"{f['name']} ×{f['n']}" for f in files)


def _plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


@dataclass
class TreeReport:
    roots: list[str]
    names: list[str]
    rows: list[dict[str, dict]]  # per root: path -> summary row

    def _children(self, no: int, path: str) -> list[str]:
        return sorted((p for p in self.rows[no] if p and p.rpartition("/")[0] == path), key=lambda p: p.rpartition("/")[2])

    def _lines(self, no: int, path: str, indent: str) -> list[str]:
        row = self.rows[no][path]
        out = [indent + n for n in (*row["markers"], *row["build"])]
        if row["files"]:
            out.append(indent + _counts(row["files"]))
        out += [f"{indent}{n}/  skipped" for n in row["skipped"]]
        for child in self._children(no, path):
            name, inner = child.rpartition("/")[2], self.rows[no][child]
            if inner["open"]:
                out += [f"{indent}{name}/", *self._lines(no, child, indent + "  ")]
                continue
            parts = [f"{name}/"]
            if inner["build"]:
                parts.append("  ".join(inner["build"]))
            if inner["file_count"]:
                parts += [_plural(inner["file_count"], "file"), _counts(inner["files"])]
            if inner["directories"]:
                parts += [_plural(inner["directories"], "dir"), f"depth {inner['depth']}"]
            out.append(indent + "  ".join(parts))
        return out

    def to_text(self) -> str:
        blocks = []
        for no, root in enumerate(self.roots):
            body = "\n".join(self._lines(no, "", ""))
            blocks.append("\n".join(x for x in (root, body) if x) if len(self.roots) > 1 else body)
        text = "\n\n".join(blocks)
        return text + "\n" if text else ""

    def _node(self, no: int, path: str) -> dict:
        row = self.rows[no][path]
        base = {"path": path, "build": row["build"], "files": {f["name"]: f["n"] for f in row["files"]}, "file_count": row["file_count"]}
        if not row["open"]:
            return base | {"directories": row["directories"], "depth": row["depth"]}
        inner = self._children(no, path)
        return {"path": path, "markers": row["markers"]} | base | {
            "skipped": row["skipped"],
            "collapsed": [self._node(no, p) for p in inner if not self.rows[no][p]["open"]],
            "children": [self._node(no, p) for p in inner if self.rows[no][p]["open"]],
        }

    def to_dict(self) -> dict:
        return {"version": 1, "roots": [{"path": r, "name": n, "tree": self._node(i, "")} for i, (r, n) in enumerate(zip(self.roots, self.names))]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2) + "\n"


def scan_tree(spark: SparkSession, *roots: str, ignore: bool = True) -> TreeReport:
    """The abstract of one or several roots; a root given twice counts once."""
    unique = list(dict.fromkeys(os.path.realpath(r) for r in roots))
    print("walk", file=sys.stderr, flush=True)
    tree = read_tree(spark, unique, ignore)
    entries = classified(tree).persist()
    print(f"walk {entries.count()}", file=sys.stderr, flush=True)
    rows: list[dict[str, dict]] = [{} for _ in unique]
    for r in summarize(entries, tree.where("fate <> 'file'").select("root_no", "dir", "fate")).collect():
        rows[r["root_no"]][r["path"]] = r.asDict(True)
    entries.unpersist()
    return TreeReport(unique, root_names(unique), rows)
