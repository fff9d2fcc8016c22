from quarry.operators.closure import closure
from quarry.operators.decls import drop_unused_modules, scopes, shell_functions, without_internal

OCC = "path string, language string, module string, symbol string, line int, skips_function boolean, owner string"
DEF = "path string, language string, kind string, k string, v string"


def kept(spark, occurrences, defs):
    occ = spark.createDataFrame([(p, la, m, s, i, skip, own) for i, (p, la, m, s, skip, own) in enumerate(occurrences)], OCC)
    return sorted((r.module, r.symbol) for r in without_internal(occ, spark.createDataFrame(defs, DEF)).collect())


def test_bare_functions_share_groups(spark):
    occ = [("a.c", "c", "", "mine", False, ""), ("a.cpp", "cpp", "", "mine", False, ""), ("a.c", "c", "", "fopen", False, ""), ("x.ps1", "powershell", "", "Get-Mine", False, ""), ("x.php", "php", "", "mine", False, "")]
    assert kept(spark, occ, [("b.cpp", "cpp", "function", "mine", ""), ("y.ps1", "powershell", "function", "get-mine", "")]) == [("", "fopen"), ("", "mine")]


def test_shell_sees_its_own_and_sourced_functions_even_in_cycles(spark):
    defs = [
        ("bin/a.sh", "shell", "source", "../lib/b.sh", ""), ("lib/b.sh", "shell", "source", "./c.sh", ""), ("lib/c.sh", "shell", "source", "../bin/a.sh", ""), ("lib/c.sh", "shell", "function", "deep", ""),
        ("bin/a.sh", "shell", "source", "../../out.sh", ""), ("z.sh", "shell", "function", "other", ""),
    ]
    seen = {(r.path, r.key) for r in shell_functions(spark.createDataFrame(defs, DEF)).collect()}
    assert seen == {("bin/a.sh", "deep"), ("lib/b.sh", "deep"), ("lib/c.sh", "deep"), ("z.sh", "other")}
    occ = [("bin/a.sh", "shell", "", "deep", False, ""), ("bin/a.sh", "shell", "", "other", False, ""), ("lib/b.sh", "shell", "", "deep", True, "")]
    assert kept(spark, occ, defs) == [("", "deep"), ("", "other")]


def test_types_and_members(spark):
    defs = [
        ("F.java", "java", "scope", "p.Foo", ""), ("F.java", "java", "scope", "p.Foo\0run", ""), ("K.kt", "kotlin", "scope", "p.Kat.Companion\0make", ""), ("K.kt", "kotlin", "scope", "p\0top", ""),
        ("g.go", "go", "scope", "ex/diag\0Hello", ""), ("c.cpp", "cpp", "scope", "Box\0open", ""),
    ]
    occ = [
        ("A.java", "java", "p.Foo", "", False, ""), ("A.java", "java", "p.Foo", "run", False, ""), ("A.java", "java", "p.Foo", "hashCode", False, ""), ("A.kt", "kotlin", "p.Kat", "make", False, ""), ("A.kt", "kotlin", "p.top", "", False, ""),
        ("m.go", "go", "ex/diag", "Hello.Code", False, ""), ("m.go", "go", "ex/diag", "Read", False, ""), ("d.cpp", "cpp", "", "open", False, "Box"), ("d.cpp", "cpp", "", "open", False, ""),
    ]
    assert kept(spark, occ, defs) == [("", "open"), ("ex/diag", "Read"), ("p.Foo", "hashCode")]


def test_an_alias_moves_whole_subtrees_only(spark):
    """Every item below an aliased path is declared under the public name too; a longer crate name is another crate."""
    items = ["quay\0dock", "quay::berth\0moor", "quays\0other", "quay::berth::rope\0tie"]
    aliases = [("port::pier", "quay"), ("port::slip", "quay::berth")]
    defs = [("x.rs", "rust", "scope", k, "") for k in items] + [("y.rs", "rust", "alias", k, v) for k, v in aliases]
    keys = {r.key for r in scopes(spark.createDataFrame(defs, DEF)).collect()}
    moved = {public + k[len(target) :] for public, target in aliases for k in items if k.startswith((f"{target}\0", f"{target}::"))}
    assert keys == {*items} | moved and len(moved) == 5


def test_unused_modules(spark):
    occ = spark.createDataFrame([("a.py", "python", "os", "", 1, False, ""), ("a.py", "python", "os", "walk", 2, False, ""), ("b.py", "python", "os", "", 1, False, ""), ("b.py", "python", "", "open", 3, False, "")], OCC)
    assert {(r.path, r.module, r.symbol) for r in drop_unused_modules(occ).collect()} == {("a.py", "os", "walk"), ("b.py", "os", ""), ("b.py", "", "open")}


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (None, 1)], "src int, dst int")
    assert {(r.src, r.dst) for r in closure(edges).collect()} == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}
