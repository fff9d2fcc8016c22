"""Queries that write a small tree to the shared folder and run whole reports, the walker and the label cascade on it."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators.closure import shared_folder
from quarry.operators.decls import without_internal
from quarry.plans.cascade import Cascade, LabelCache
from quarry.plans.fixtures import _values, listing
from quarry.plans.io_report import extract, nearest_packages, resources, scan_io
from quarry.plans.tree_report import scan_tree
from quarry.sources.tree import MOST_BYTES, read_tree

#: A harbour's folder: ignored, skipped, linked, binary, wide, oversized and empty files.
HARBOUR: dict[str, str | bytes | int] = {
    ".gitignore": "*.log\n/old\n!keep.log\n", "crane/crane.py": "open('load')\n", "crane/day.log": "lift\n", "crane/keep.log": "kept\n", "old/pier.c": "int x;\n", "crane/old/pier.c": "int y;\n",
    "quay/build/stone.go": "package stone\n", "quay/build/stone.o": "o\n", "shed/build/plank.txt": "p\n", "shed/node_modules/a.js": "a\n", "ship/empty.rb": "", "ship/hull.bin": b"hull\0plate", "ship/log.txt": "day one".encode("utf-16"),
    "ship/anchor.dat": MOST_BYTES + 1, "ship/chain.dat": MOST_BYTES, "ship/.git/config": "c\n", "ship/Cargo.toml": '[package]\nname = "ship"\n', "ship/src/main.rs": "fn main() { std::fs::remove_file(\"rust\").unwrap(); }\n", ".dock/go.mod": "module dock\n",
}

#: Programs in further languages, with names that they declare, broken files, odd encodings and files that only name a language.
GUILD: dict[str, str | bytes] = {
    "Loom.cs": "using Box = System.IO;\nnamespace Guild { class Loom { void Run() { Box.File.Delete(\"a\"); Thread.Cut(); log($\"x {Box.File.Exists(\"b\")}\"); } } class Thread { public static void Cut() {} } }\n",
    "Kiln.kt": "import java.io.File as Clay\nimport java.net.Socket\nfun main() { println(\"at ${Clay(\"pot\")}\"); Socket(\"h\", 1) }\n",
    "forge.cc": "#include <fstream>\n#include \"forge.hpp\"\nvoid Forge::open() { heat(); ::popen(\"b\", \"r\"); }\n", "forge.hpp": "class Forge { public: void open(); void heat(); };\n",
    "mint.rb": "require 'socket'\nclass Coin\n  def self.stamp; end\nend\nCoin.stamp\nIO.popen('x')\n",
    "DSC_Seal/DSC_Seal.schema.mof": '[ClassVersion("1.0"), FriendlyName("WaxSeal")]\nclass DSC_Seal {}\n', "DSC_Seal/DSC_Seal.psm1": "function Get-Mark { gc a }\n", "press.ps1": "# rm nothing\nWaxSeal One\n{\n    Depth = 'x'\n}\nGet-Mark\ndel b\n",
    "deal.sh": "case $1 in\n  buy|take) curl x ;;\n  *)\n    wget y ;;\nesac\nfind . -name z -exec rm {} \\;\nscp a b:\n",
    "page.js": "import fs from 'fs'\nconst quote = /[\"'`]/\nfs.stat(`${fs.rmSync('a')}`)\n", "broken.js": "this is ( not [ a } program at all\n", "broken.py": "def (:\n",
    "latin.py": "# coding: latin-1\nopen('caf\u00e9')\n".encode("latin-1"), "wide.py": "open('a')\n".encode("utf-16"), "byte.py": b"open('caf\xe9')\n", "rule": "#!/usr/bin/env -S bash -e\nmkdir a\n", "list.json": "{}\n", "plain.h": "int f(int);\n", "twin.h": "namespace n { template <class T> struct P; }\n",
    "go.mod": "module guild.example/all\n", "unit/u.go": "package unit\n\nvar Scale = 1\n", "weigh.go": "package main\n\nimport (\n\t\"guild.example/all/unit\"\n\t\"os\"\n)\n\nfunc f() {\n\tunit.Scale.Set()\n\tos.Remove(\"a\")\n}\n\nfunc g(os Box) {\n\tos.Remove(\"b\")\n}\n",
    "macro.c": "#include <unistd.h>\n#define WIPE(x) unlink(x)\nint main(void) { WIPE(\"a\"); return 0; }\n",
}


def plant(spark: SparkSession, df_of: DataFrame, files: dict[str, str | bytes | int], name: str) -> str:
    """Write such files (a number: so many bytes) below a new folder and return it. The walker reads mounted folders, so the shared folder must be one."""
    base = shared_folder(df_of)
    if not base.startswith(("file:", "/")):
        raise ValueError("trees are read from mounted folders only")
    root = os.path.join("/" + base.removeprefix("file:").lstrip("/"), "quarry", uuid.uuid4().hex, name)
    for rel, content in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            if isinstance(content, int):
                f.truncate(content)
            else:
                f.write(content.encode() if isinstance(content, str) else content)
    return root


def _query(columns: str, rows: list[tuple]):
    def keep(f):
        registry.QUERIES[f.__name__] = f
        registry.ORACLES[f.__name__] = _values(columns, rows)
        return f

    return keep


_BOTH = [("", "enter"), (".dock", "enter"), (".dock/go.mod", "file"), (".gitignore", "file"), ("crane", "enter"), ("crane/crane.py", "file"), ("crane/keep.log", "file"), ("crane/old", "enter"), ("crane/old/pier.c", "file"), ("quay", "enter"), ("quay/build", "enter"), ("quay/build/stone.go", "file"), ("quay/build/stone.o", "file"), ("shed", "enter"), ("shed/node_modules", "skip"), ("ship", "enter"), ("ship/Cargo.toml", "file"), ("ship/empty.rb", "file"), ("ship/log.txt", "file"), ("ship/src", "enter"), ("ship/src/main.rs", "file")]


@_query(
    "mode, path, fate",
    [("code", *r) for r in _BOTH] + [("tree", *r) for r in _BOTH] + [("code", "shed/build", "skip"), ("tree", "shed/build", "enter"), ("tree", "shed/build/plank.txt", "file"), ("tree", "ship/anchor.dat", "file"), ("tree", "ship/chain.dat", "file"), ("tree", "ship/hull.bin", "file")],
)
def fixture_walk(spark, sf_dir):
    """What the walker lists of the harbour, for code and for the tree."""
    root = plant(spark, spark.range(1), HARBOUR, "harbour")
    os.symlink(f"{root}/ship", f"{root}/ferry")
    path = F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.col("name"))
    of = lambda mode: read_tree(spark, [root], mode=mode).select(F.lit(mode).alias("mode"), path.alias("path"), "fate")
    return of("code").unionByName(of("tree"))


def _lines(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(_line_rows(texts), "report string, n int, line string")


def _line_rows(texts: dict[str, str]) -> list[tuple]:
    return [(k, n, line) for k, t in texts.items() for n, line in enumerate(t.splitlines(), 1)]


_TREE = """\
<1>
Cargo.toml
other ×2  Ruby ×1
src/  1 file  Rust ×1

<2>
Dockerfile
deck/  Makefile  2 files  Python ×2
"""
_TREE_JSON = '{"name": "ship-2", "path": "<2>", "tree": {"build": ["Dockerfile"], "children": [], "collapsed": [{"build": ["Makefile"], "depth": 0, "directories": 0, "file_count": 2, "files": {"Python": 2}, "path": "deck"}], "file_count": 0, "files": {}, "markers": [], "path": "", "skipped": []}}'


@_query("report, n, line", _line_rows({"text": _TREE, "json": _TREE_JSON}))
def fixture_tree_report(spark, sf_dir):
    """Text and JSON of the tree report over the harbour's ship and another root of the same name."""
    first = plant(spark, spark.range(1), {k.removeprefix("ship/"): v for k, v in HARBOUR.items() if k.startswith("ship/") and not isinstance(v, int)}, "ship")
    second = plant(spark, spark.range(1), {"deck/a.py": "", "deck/b.py": "", "deck/Makefile": "all:\n", "Dockerfile": "FROM x\n"}, "ship")
    report = scan_tree(spark, first, second, first)
    clean = lambda t: t.replace(first, "<1>").replace(second, "<2>")
    return _lines(spark, {"text": clean(report.to_text()), "json": clean(json.dumps(json.loads(report.to_json())["roots"][1], sort_keys=True))})


_IO = """\
annex/z.py
  filesystem  python  os.remove  2,3

guild/DSC_Seal/DSC_Seal.psm1
  filesystem  powershell  Get-Content  1

guild/Kiln.kt
  filesystem  kotlin  java.io.File  1,3
  network  kotlin  java.net.Socket  2,3

guild/Loom.cs
  filesystem  csharp  System.IO  1
  filesystem  csharp  System.IO.File.Delete  2
  filesystem  csharp  System.IO.File.Exists  2

guild/byte.py
  filesystem  python  open  1

guild/deal.sh
  filesystem  shell  find  6
  network  shell  curl  2
  network  shell  scp  7
  network  shell  wget  4

guild/forge.cc
  filesystem  cpp  fstream  1
  process  cpp  popen  3

guild/latin.py
  filesystem  python  open  2

guild/macro.c
  filesystem  c  unlink  2

guild/mint.rb
  network  ruby  socket  1
  process  ruby  IO.popen  6

guild/page.js
  filesystem  javascript  fs.rmSync  3
  filesystem  javascript  fs.stat  3

guild/press.ps1
  filesystem  powershell  Remove-Item  7

guild/rule
  filesystem  shell  mkdir  2

guild/weigh.go
  filesystem  go  os.Remove  10

guild/wide.py
  filesystem  python  open  1
"""
_IO_LOG = """\
walk
walk 24
parse
annex/z.py python
guild/DSC_Seal/DSC_Seal.psm1 powershell
guild/Kiln.kt kotlin
guild/Loom.cs csharp
guild/byte.py python
guild/deal.sh shell
guild/forge.cc cpp
guild/forge.hpp cpp
guild/latin.py python
guild/list.json json
guild/macro.c c
guild/mint.rb ruby
guild/page.js javascript
guild/plain.h c
guild/press.ps1 powershell
guild/rule shell
guild/twin.h cpp
guild/unit/u.go go
guild/weigh.go go
guild/wide.py python
filter 23
classify
report 24
"""


@_query("report, n, line", _line_rows({"text": _IO, "log": _IO_LOG, "json": '[{"language": "python", "module": "os", "symbol": "remove", "kinds": ["filesystem"], "lines": [2, 3]}]'}))
def fixture_io_text(spark, sf_dir):
    """Text and JSON of the I/O report over the guild and a second root, with the lines that are logged."""
    import contextlib
    import io

    first, second = plant(spark, spark.range(1), GUILD, "guild"), plant(spark, spark.range(1), {"z.py": "import os\nos.remove('z')\nos.remove('y')\n"}, "annex")
    said = io.StringIO()
    with contextlib.redirect_stderr(said):
        report = scan_io(spark, first, second)
    files = {f["path"]: f["symbols"] for f in json.loads(report.to_json())["files"]}
    return _lines(spark, {"text": report.to_text(), "log": said.getvalue(), "json": json.dumps(files["annex/z.py"])})


@_query(
    "path, language, module, symbol, line",
    [
        ("DSC_Seal/DSC_Seal.psm1", "powershell", "", "Get-Content", 1), ("byte.py", "python", "", "open", 1), ("deal.sh", "shell", "", "curl", 2), ("deal.sh", "shell", "", "wget", 4), ("deal.sh", "shell", "", "find", 6), ("deal.sh", "shell", "", "scp", 7),
        ("forge.cc", "cpp", "fstream", "", 1), ("forge.cc", "cpp", "forge.hpp", "", 2), ("forge.cc", "cpp", "", "popen", 3), ("latin.py", "python", "", "open", 2), ("macro.c", "c", "unistd.h", "", 1), ("macro.c", "c", "", "unlink", 2),
        ("mint.rb", "ruby", "socket", "", 1), ("mint.rb", "ruby", "IO", "popen", 6), ("page.js", "javascript", "fs", "", 1), ("page.js", "javascript", "fs", "stat", 3), ("page.js", "javascript", "fs", "rmSync", 3), ("press.ps1", "powershell", "", "Remove-Item", 7),
        ("rule", "shell", "", "mkdir", 2), ("weigh.go", "go", "guild.example/all/unit", "", 4), ("weigh.go", "go", "os", "", 5), ("weigh.go", "go", "os", "Remove", 10), ("wide.py", "python", "", "open", 1),
        ("Kiln.kt", "kotlin", "java.io.File", "", 1), ("Kiln.kt", "kotlin", "java.net.Socket", "", 2), ("Kiln.kt", "kotlin", "java.io.File", "", 3), ("Kiln.kt", "kotlin", "java.net.Socket", "", 3),
        ("Loom.cs", "csharp", "System.IO", "", 1), ("Loom.cs", "csharp", "System.IO.File", "Delete", 2), ("Loom.cs", "csharp", "System.IO.File", "Exists", 2),
    ],
)
def fixture_languages(spark, sf_dir):
    """What the guild's programs call, after their own names are dropped, whether it does I/O or not."""
    files = listing(spark, {}).limit(0).unionByName(spark.createDataFrame([(0, p.rpartition("/")[0], p.rpartition("/")[2], "file", bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in GUILD.items()], "root_no int, dir string, name string, fate string, content binary")).drop("fate")
    rows = extract(nearest_packages(files), ["/nowhere"])
    left = without_internal(rows.where("type = 'occ'").select("path", "language", "module", "symbol", "line", "skips_function", "owner"), rows.where("type = 'def'").select("path", "language", "kind", "k", "v").unionByName(resources(files)))
    return left.select("path", "language", "module", "symbol", "line")


class _Scribe:
    """A model that knows `pen` names, garbles replies that hold `blot`, and gives up at `end`."""

    def __init__(self):
        self.asked: list[str] = []

    def __call__(self, prompt: str) -> str:
        names = [line.split("\t") for line in prompt.splitlines() if "\t" in line]
        self.asked.append(" ".join(s for _, s in names))
        if any(s == "end" for _, s in names):
            raise RuntimeError("out of ink")
        if any(s == "blot" for _, s in names):
            return "..."
        return json.dumps({"results": [{"module": m, "symbol": s, "io": s.startswith("pen"), "kinds": ["filesystem"]} for m, s in names]})


@_query(
    "run, kind, name, value",
    [
        (1, "asked", "0", "pencil"), (1, "asked", "1", "pen " + " ".join(f"pin{i:02d}" for i in range(29))), (1, "asked", "2", "pin29"), (1, "label", "go desk pencil", "True filesystem"), (1, "label", "python  open", "True filesystem"), (1, "label", "python desk pen", "True filesystem"),
        (2, "asked", "0", "blot penknife"), (2, "asked", "1", "blot"), (2, "asked", "2", "penknife"), (2, "label", "python desk blot", "False "), (2, "label", "python desk pen", "True filesystem"), (2, "label", "python desk penknife", "True filesystem"),
        (3, "asked", "0", "end"), (3, "label", "go desk end", "False "), (3, "label", "python desk penny", "False "), (4, "asked", "0", "pen pin00"), (4, "label", "python desk pen", "True filesystem"),
    ],
)
def fixture_cascade(spark, sf_dir):
    """Labels of four runs over one cache, and the batches that the model was asked in each."""
    base = shared_folder(spark.range(1))
    cache = f"{base}/quarry/labels-{uuid.uuid4().hex}"
    runs = [
        ([("python", "", "open"), ("python", "desk", "pen"), *(("python", "desk", f"pin{i:02d}") for i in range(30)), ("go", "desk", "pencil")], False),
        ([("python", "desk", "pen"), ("python", "desk", "blot"), ("python", "desk", "penknife")], False),
        ([("go", "desk", "end"), ("python", "desk", "penny")], False),
        ([("python", "desk", "pen"), ("python", "desk", "pin00")], True),
    ]
    out = []
    for n, (names, refresh) in enumerate(runs, 1):
        scribe = _Scribe()
        found = Cascade(LabelCache(spark, cache), "scribe", scribe, refresh)(spark.createDataFrame(names, "language string, module string, symbol string")).collect()
        out += [(n, "label", f"{r.language} {r.module} {r.symbol}", f"{r.io} {','.join(r.kinds)}") for r in found if not r.symbol.startswith("pin")]
        out += [(n, "asked", str(i), a) for i, a in enumerate(scribe.asked)]
    return spark.createDataFrame(out, "run int, kind string, name string, value string")
