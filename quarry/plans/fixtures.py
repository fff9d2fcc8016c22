"""Small trees that we carry, as listings, and queries that run the real operators on them. They ignore the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators.decls import drop_unused_modules, without_internal
from quarry.operators.labels import known, label
from quarry.operators.report import lines_by_file
from quarry.operators.tree import classified, summarize

#: A bakery's repository: two packages, build files by name and by content, skipped and hidden parts.
BAKERY = {
    "go.work": "go 1.22\n",
    "LICENSE": "free\n",
    "Makefile": "bread:\n\techo bread\n",
    "ovens/oven.go": "package ovens\n",
    "ovens/heat/gas.go": "package heat\n",
    "ovens/heat/wood.rs": "fn main() {}\n",
    "ovens/vendor/lib.go": "package lib\n",
    "shop/till/pyproject.toml": "[project]\n",
    "shop/till/till.py": "x = 1\n",
    "shop/till/tests/a/b/test_till.py": "y = 1\n",
    "shop/window/sign.txt": "open\n",
    "deploy/stack.yml": "Resources:\n  Q:\n    Type: AWS::SQS::Queue\n",
    "deploy/play.yaml": "- hosts: ovens\n  roles:\n    - baker\n",
    "deploy/pods.json": '{"apiVersion": "v1", "kind": "Pod"}\n',
    "deploy/plain.yml": "colour: brown\n",
    "deploy/image/cake": "FROM busybox\nCOPY cake /cake\n",
    ".hooks/ci.yml": "on: push\njobs:\n  bake: {}\n",
    ".hooks/rules": "ifeq ($(A),b)\nendif\n",
}

#: A courier's programs in several languages, with names that they declare themselves.
COURIER = {
    "go.mod": "module post.example/courier\n",
    "route/route.go": "package route\n\nvar Map = 1\n\nfunc Plan() {}\n",
    "main.go": 'package main\n\nimport (\n\t"net/http"\n\t"post.example/courier/route"\n\tsys "os"\n)\n\nfunc main() {\n\troute.Plan()\n\tsys.Open("parcel")\n\thttp.Get("https://depot")\n}\n',
    "track.py": "import socket\nfrom urllib.request import urlopen\n\nwith open('log') as f:\n    urlopen(f.read())\nsocket.create_connection(('depot', 80))\n",
    "bin/send.sh": "#!/bin/sh\n. ../lib/say.sh\nsay hello\nscp parcel depot: 2>/dev/null\n",
    "lib/say.sh": "say() { echo \"$1\"; }\n",
    "web/app.ts": "import { spawn as run } from 'node:child_process'\nimport * as disk from 'fs'\n\nrun('van')\ndisk.rmSync('old')\n",
    "pack.rs": "use std::fs::{self, File};\nfn main() { let _ = File::create(\"box\"); fs::rename(\"a\", \"b\"); }\n",
    "Depot.java": "import java.net.Socket;\nclass Depot { void open() throws Exception { new Socket(\"h\", 1); stamp(); } void stamp() {} }\n",
    "label.php": "<?php\nuse function mail\\stamp as st;\nfunction glue() {}\nglue();\nunlink('label');\n",
    "weigh.c": "#include <stdio.h>\n#include \"scale.h\"\nstatic int grams(void) { return 1; }\nint main(void) { grams(); fopen(\"w\", \"r\"); return 0; }\n",
    "scale.h": "int zero(void);\n",
}


def listing(spark: SparkSession, files: dict[str, str], skipped: tuple[str, ...] = ()) -> DataFrame:
    """The rows that the tree source gives for such files: root_no, dir, name, fate, content."""
    dirs = {""} | {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)}
    dirs = {d for d in dirs if not any(d == s or d.startswith(s + "/") for s in skipped)}
    rows = [(0, d, None, "enter", None) for d in dirs] + [(0, s, None, "skip", None) for s in skipped]
    rows += [(0, p.rpartition("/")[0], p.rpartition("/")[2], "file", bytearray(text, "utf-8")) for p, text in files.items() if p.rpartition("/")[0] in dirs]
    return spark.createDataFrame(rows, "root_no int, dir string, name string, fate string, content binary")


def _values(columns: str, rows: list[tuple]) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def fixture_tree_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and collapsed directories of the bakery."""
    tree = listing(spark, BAKERY, ("ovens/vendor",))
    rows = summarize(classified(tree), tree.where("fate <> 'file'").select("root_no", "dir", "fate"))
    counts = F.array_join(F.transform("files", lambda f: F.concat(f["name"], F.lit(" x"), f["n"].cast("string"))), " ")
    return rows.select("path", F.when(F.col("open"), "open").otherwise("line").alias("kind"), F.array_join("markers", " ").alias("markers"), F.array_join("build", " ").alias("build"), counts.alias("files"), F.array_join("skipped", " ").alias("skipped"), F.col("directories").cast("int").alias("directories"), "depth")


registry.QUERIES["fixture_tree_abstract"] = fixture_tree_abstract
registry.ORACLES["fixture_tree_abstract"] = _values(
    "path, kind, markers, build, files, skipped, directories, depth",
    [
        ("", "open", "go.work", "Makefile", "other x1", "", 0, 0),
        (".hooks", "line", "", "ci.yml rules", "", "", 0, 0),
        ("deploy", "line", "", "image/cake play.yaml pods.json stack.yml", "other x1", "", 1, 1),
        ("ovens", "line", "", "", "Go x2 Rust x1", "", 2, 1),
        ("shop", "open", "", "", "", "", 0, 0),
        ("shop/till", "open", "pyproject.toml", "", "Python x1", "", 0, 0),
        ("shop/till/tests", "line", "", "", "Python x1", "", 2, 2),
        ("shop/window", "line", "", "", "other x1", "", 0, 0),
    ],
)


def fixture_io_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the courier's programs do: extraction, own names dropped, labels, lines by file."""
    from quarry.plans.io_report import drop_own_includes, extract, nearest_packages

    files = listing(spark, COURIER).where("fate = 'file'").select("root_no", "dir", "name", "content")
    rows = extract(nearest_packages(files), ["/nowhere"])
    seen = rows.where("type = 'occ'").select("path", "root_no", "language", "module", "symbol", "line", "skips_function", "owner", "include")
    seen = drop_unused_modules(drop_own_includes(seen, files)).drop("root_no", "include")
    left = without_internal(seen, rows.where("type = 'def'").select("path", "language", "kind", "k", "v"))
    found = lines_by_file(left, known(label(left.select("language", "module", "symbol"))))
    return found.select("path", "language", "module", "symbol", F.array_join("kinds", ",").alias("kinds"), F.array_join(F.transform("lines", lambda n: n.cast("string")), ",").alias("lines"))


registry.QUERIES["fixture_io_report"] = fixture_io_report
registry.ORACLES["fixture_io_report"] = _values(
    "path, language, module, symbol, kinds, lines",
    [
        ("main.go", "go", "os", "Open", "filesystem", "11"),
        ("main.go", "go", "net/http", "Get", "network", "12"),
        ("track.py", "python", "", "open", "filesystem", "4"),
        ("track.py", "python", "urllib.request", "urlopen", "network", "2,5"),
        ("track.py", "python", "socket", "create_connection", "network", "6"),
        ("bin/send.sh", "shell", "", "scp", "network", "4"),
        ("bin/send.sh", "shell", "", "redirect", "filesystem", "4"),
        ("web/app.ts", "typescript", "node:child_process", "spawn", "process", "1,4"),
        ("web/app.ts", "typescript", "fs", "rmSync", "filesystem", "5"),
        ("pack.rs", "rust", "std::fs", "File", "filesystem", "1"),
        ("pack.rs", "rust", "std::fs::File", "create", "filesystem", "2"),
        ("pack.rs", "rust", "std::fs", "rename", "filesystem", "2"),
        ("Depot.java", "java", "java.net.Socket", "", "network", "1,2"),
        ("label.php", "php", "", "unlink", "filesystem", "5"),
        ("weigh.c", "c", "stdio.h", "", "filesystem", "1"),
        ("weigh.c", "c", "", "fopen", "filesystem", "4"),
    ],
)
