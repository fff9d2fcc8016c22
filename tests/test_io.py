import json

from pyspark.sql import functions as F

from quarry.cli import main
from quarry.plans.fixtures import COURIER
from quarry.plans.io_report import scan_io
from quarry.sources.tree import read_tree


def seen(spark, root, *more):
    """The symbols that survive the declarations, with the labels that the table gives, and the report."""
    caught = {}

    def classifier(symbols):
        from quarry.operators.labels import known, label

        caught["all"] = {(r.language, r.module, r.symbol) for r in symbols.collect()}
        return known(label(symbols))

    report = scan_io(spark, root, *more, classifier=classifier)
    return caught["all"], report


def names(report):
    return {(s["language"], s["module"], s["symbol"]) for f in report.to_dict()["files"] for s in f["symbols"]}


COURIER_TEXT = """\
Depot.java
  network  java  java.net.Socket  1,2

bin/send.sh
  filesystem  shell  redirect  4
  network  shell  scp  4

label.php
  filesystem  php  unlink  5

main.go
  filesystem  go  os.Open  11
  network  go  net/http.Get  12

pack.rs
  filesystem  rust  std::fs.File  1
  filesystem  rust  std::fs.rename  2
  filesystem  rust  std::fs::File.create  2

track.py
  filesystem  python  open  4
  network  python  socket.create_connection  6
  network  python  urllib.request.urlopen  2,5

web/app.ts
  filesystem  typescript  fs.rmSync  5
  process  typescript  node:child_process.spawn  1,4

weigh.c
  filesystem  c  fopen  4
  filesystem  c  stdio.h  1
"""


def test_report(spark, plant, capsys):
    root = plant({**COURIER, "broken.py": "no python here !!!\n", "wide.py": "pass\n".encode("utf-16")})
    assert scan_io(spark, root).to_text() == COURIER_TEXT
    err = capsys.readouterr().err.splitlines()
    assert {"track.py python", "wide.py python", "scale.h c"} <= set(err) and "broken.py python" not in err
    assert [x.split()[0] for x in err if x.split()[0] in ("walk", "parse", "filter", "classify", "report")] == ["walk", "walk", "parse", "filter", "classify", "report"]


def test_more_languages(spark, plant):
    root = plant({
        "V.tsx": "import { execFile } from 'child_process'\nconst v = <b>fetch</b>;\nexecFile('v')\n", "o.mjs": "const { unlink: cut, stat } = require('node:fs')\ncut('x'); stat('y'); this.fetch(1); fetch(2)\n",
        "K.kt": "import java.io.File as Paper\nimport kotlin.io.println\nfun main() { Paper(\"a\"); println(1) }\n", "r.rb": "require 'socket'\nclass A\n  def go; end\nend\nIO.popen('x')\nA.go\nspawn 'y'\ngo\n",
        "p.ps1": "# rm nothing\nfunction Bake { gci . | del }\nbake\n$x = iwr http://a\nGet-NetIPAddress\n", "C.cs": "using IO = System.IO;\nnamespace N { class P { void M() { IO.File.Delete(\"a\"); Help.Me(); lower.Read(); new Sys.Thing(); new List<int>(); } } class Help { public static void Me() {} } }\n",
        "q.php": "<?php\nclass F { function fopen() {} }\n$f->fopen(); F::unlink(); \\fopen('a'); A\\touch('b'); echo 'curl_init()';\n", "x.cc": "#include <fstream>\nvoid f() { std::system(\"a\"); ::popen(\"b\", \"r\"); }\n",
    })
    caught, report = seen(spark, root)
    assert names(report) == {
        ("tsx", "child_process", "execFile"), ("javascript", "node:fs", "unlink"), ("javascript", "node:fs", "stat"), ("javascript", "", "fetch"), ("kotlin", "java.io.File", ""),
        ("ruby", "socket", ""), ("ruby", "IO", "popen"), ("ruby", "", "spawn"), ("powershell", "", "Get-ChildItem"), ("powershell", "", "Remove-Item"), ("powershell", "", "Invoke-WebRequest"), ("powershell", "", "Get-NetIPAddress"),
        ("csharp", "System.IO", ""), ("csharp", "System.IO.File", "Delete"), ("php", "", "fopen"), ("cpp", "fstream", ""), ("cpp", "", "popen"),
    }
    assert ("csharp", "Sys.Thing", "") in caught and not {("csharp", "Help", "Me"), ("csharp", "lower", "Read"), ("ruby", "A", "go"), ("ruby", "", "go"), ("powershell", "", "bake")} & caught


def test_declared_names_go(spark, plant):
    root = plant({
        "go.mod": "module ex.org/app\n", "diag/d.go": "package diag\nvar Hello = 1\nfunc Read() {}\ntype T struct{}\n", "main.go": 'package main\nimport (\n\t"ex.org/app/diag"\n\t"net/http"\n\t"os"\n)\nfunc main() {\n\tdiag.Read()\n\tdiag.Hello.Code()\n\tdiag.Other()\n\thttp.Get("x")\n}\nfunc f(os T) { os.Remove("x") }\nfunc g() { os.Open("x"); os := 1; os.Stat(1) }\n',
        "pkg/package.json": '{"name": "@a/b"}', "pkg/src/util.ts": "export function go() {}\nexport const z = 1\n", "pkg/src/use.ts": "import { go, other } from '@a/b/src/util'\ngo()\nother()\n",
        "cr/Cargo.toml": '[package]\nname = "my-crate"\n', "cr/src/net.rs": "pub struct S;\nimpl S { pub fn open() {} }\npub fn go() {}\n", "cr/tests/t.rs": "use my_crate::net::{go, S, Missing};\nfn main() { go(); S::open(); S::gone(); }\n",
        "p/Foo.java": "package p;\npublic class Foo { static int N = 1; enum K { A, B } public void run() { helper(); } }\n", "q/Use.kt": "import p.Foo\nimport p.Bar as B\nfun main() { Foo.run(); Foo.walk(); B.x() }\n",
    })
    caught, _ = seen(spark, root)
    assert {x for x in caught if x[0] == "go"} == {("go", "ex.org/app/diag", "Other"), ("go", "net/http", "Get"), ("go", "os", "Open")}
    assert {x for x in caught if x[0] == "typescript"} == {("typescript", "@a/b/src/util", "other")}
    assert {x for x in caught if x[0] == "rust"} == {("rust", "my_crate::net", "Missing"), ("rust", "my_crate::net::S", "gone")}
    assert {x for x in caught if x[0] == "kotlin"} == {("kotlin", "p.Foo", "walk"), ("kotlin", "p.Bar", "x")}


def test_modules_that_the_workspace_names(spark, plant):
    """Names from packages, their exports and imports, and compiler paths are the corpus's own; others are not."""
    package = {"name": "@mill/grain", "exports": {"./sieve": "./a.js", "default": "./b.js"}, "imports": {"#wheel/*": "./w/*.js", "hub": "./h.js"}}
    used = ["@mill/grain", "@mill/grain/sieve", "#wheel/big/rim", "$mix/dough/fine", "@mill/grain/hidden", "hub", "$mix", "node:net"]
    calls = "".join(f"import {{ c{i} }} from '{m}';\nc{i}();\n" for i, m in enumerate(used))
    root = plant({"mill/package.json": json.dumps(package), "shop/tsconfig.json": json.dumps({"compilerOptions": {"paths": {"$mix/*": ["x"]}}}), ".cache/package.json": '{"name": "hub"}', "shop/counter.mts": calls})
    caught, _ = seen(spark, root)
    assert {m for _, m, _ in caught} == set(used[4:])


def test_shell_forms(spark, plant):
    root = plant({
        "a.sh": '#!/bin/bash\n. lib/b.sh\nhelper\ncommand helper\nsudo -n rm x\nV=curl\n"$V" x\nf() {\n  local T=wget\n  $T y\n}\nf\ncat <<EOF\nssh nothing\nEOF\necho "$(mkdir z)" # touch no\n', "lib/b.sh": "helper() { tar x; }\n", "tool": b"#!/usr/bin/env dash\nls\n"})
    caught, report = seen(spark, root)
    shell = {s for _, _, s in caught}
    assert {"helper", "curl", "wget", "cat", "redirect", "tar", "ls", "echo"} <= shell and not {"f", "ssh", "touch", "local"} & (shell - {"local"})
    assert ("shell", "", "ls") in names(report)


def test_c_family(spark, plant):
    root = plant({
        "inc/own.h": "#ifndef X\n#define X\nint add(int a, int b);\n#define SEND(x) send(x, 1)\n#define open my_open\n#endif\n", "a.c": '#include "own.h"\n#include "inc/own.h"\n#include <fcntl.h>\nint main(void) { add(1, 2); SEND(3); read(1); return 0; }\n',
        "box.hpp": "namespace N { class Box { public: void open(); int size() { return read(); } }; }\n", "box.cpp": '#include "box.hpp"\nvoid Box::open() { size(); ::read(1); N::Box::stat(); unlink("x"); }\n',
    })
    caught, _ = seen(spark, root)
    assert {x for x in caught if x[0] == "c"} == {("c", "fcntl.h", ""), ("c", "", "send"), ("c", "", "read")}
    assert {x for x in caught if x[0] == "cpp"} == {("cpp", "", "read"), ("cpp", "Box", "stat"), ("cpp", "", "unlink")}


def test_two_roots_share_declarations(spark, plant):
    left, right = plant({"a.php": "<?php unlink_all(); unlink('x');"}, "one"), plant({"b.php": "<?php function unlink_all() {}"}, "two")
    caught, report = seen(spark, left, right)
    assert caught == {("php", "", "unlink")} and report.to_dict()["files"][0]["path"] == "one/a.php" and report.root == f"{left}\n{right}"


def listed(spark, root, **more):
    rows = read_tree(spark, [root], **{"mode": "code"} | more).select("fate", F.concat_ws("/", F.nullif("dir", F.lit("")), "name").alias("p")).collect()
    return {r.p for r in rows if r.fate == "file"}, {r.p for r in rows if r.fate == "skip"}


def test_what_is_too_large_or_binary(spark, plant):
    from quarry.sources.tree import BINARY_PROBE, MOST_BYTES

    zeros = {"at_once": b"\0", "in_probe": b"." * (BINARY_PROBE - 1) + b"\0", "past_probe": b"." * BINARY_PROBE + b"\0", "as_utf16": "hej".encode("utf-16")}
    root = plant({**zeros, "full": b"." * MOST_BYTES, "over": b"." * (MOST_BYTES + 1), "none": b""})
    assert listed(spark, root)[0] == {"past_probe", "as_utf16", "full", "none"}
    assert listed(spark, root, mode="tree")[0] == {*zeros, "full", "over", "none"}


def test_what_is_not_entered(spark, plant):
    root = plant({".gitignore": "*.tmp\n/quiet\n", "attic/box.tmp": "", "attic/box.c": "", "quiet/c.c": "", "attic/quiet/d.c": "", "attic/dist/e.c": "", "attic/.git/f.c": "", "yard/build/g.rs": "", "yard/build/h.o": "", "hall/build/i.o": ""})
    assert listed(spark, root) == ({".gitignore", "attic/box.c", "attic/quiet/d.c", "yard/build/g.rs", "yard/build/h.o"}, {"attic/dist", "hall/build"})
    files, skipped = listed(spark, root, ignore=False)
    assert not skipped and {"attic/box.tmp", "quiet/c.c", "attic/dist/e.c", "hall/build/i.o"} <= files and "attic/.git/f.c" not in files


def test_links_are_not_followed(spark, plant, tmp_path):
    root = plant({"real/x.py": ""})
    (tmp_path / "also").symlink_to(tmp_path / "real")
    (tmp_path / "y.py").symlink_to(tmp_path / "real" / "x.py")
    assert listed(spark, root)[0] == {"real/x.py"}


def test_cli(spark, plant, tmp_path, capsys):
    root = plant({"x/pyproject.toml": "", "x/a.py": "open('b')\n"})
    out = tmp_path / "out.json"
    assert main(["io", f"{root}/x", "--format", "json", "--output", str(out)], spark) == 0
    assert capsys.readouterr().out == ""
    assert json.loads(out.read_text())["files"][0]["symbols"][0] == {"language": "python", "module": "", "symbol": "open", "kinds": ["filesystem"], "lines": [1]}
    assert main(["tree", f"{root}/x"], spark) == 0
    assert capsys.readouterr().out == "pyproject.toml\nPython ×1\n"
