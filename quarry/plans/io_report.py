"""Which files do I/O, and by which names: list, extract, drop what the corpus declares, label, report."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.extract import Context, Found, compiled, scripts
from quarry.extract.detect import detect, named
from quarry.operators.decls import drop_unused_modules, without_internal
from quarry.operators.labels import known, label
from quarry.operators.report import files as by_file
from quarry.operators.tree import prefixes
from quarry.plans.tree_report import root_names
from quarry.sources.decode import decode
from quarry.sources.tree import read_tree

EXTRACTORS: dict[str, Callable[[str, Context], Found | None]] = {
    "python": scripts.python, "javascript": scripts.javascript, "typescript": scripts.javascript, "tsx": scripts.javascript, "ruby": scripts.ruby, "php": scripts.php, "powershell": scripts.powershell, "shell": scripts.shell,
    "go": compiled.go, "rust": compiled.rust, "java": compiled.java, "kotlin": compiled.kotlin, "csharp": compiled.csharp, "c": compiled.c, "cpp": compiled.cpp,
}
_FIELDS = [("type", pa.string()), ("path", pa.string()), ("root_no", pa.int32()), ("language", pa.string()), ("module", pa.string()), ("symbol", pa.string()), ("line", pa.int32()), ("skips_function", pa.bool_()), ("owner", pa.string()), ("include", pa.string()), ("kind", pa.string()), ("k", pa.string()), ("v", pa.string())]
_ROWS = "type string, path string, root_no int, language string, module string, symbol string, line int, skips_function boolean, owner string, include string, kind string, k string, v string"
_MANIFESTS = {"go.mod": "go", "package.json": "js", "Cargo.toml": "rust"}


def nearest_packages(listing: DataFrame) -> DataFrame:
    """The files with package_dir and package: the nearest manifest above that names a package in the file's language."""
    name, text = F.col("name"), F.make_valid_utf8(F.col("content").cast("string"))
    named = (
        F.when(name == "go.mod", F.regexp_extract(text, r"(?md)^[ \t]*module[ \t]+\"?([^\s\"]+)", 1))
        .when(name == "package.json", F.get_json_object(text, "$.name"))
        .when(name == "Cargo.toml", F.regexp_extract(text, r"(?sd)\[package\][^\[]*?\n[ \t]*name[ \t]*=[ \t]*[\"']([^\"']+)", 1))
    )
    table = F.create_map(*[F.lit(x) for p in _MANIFESTS.items() for x in p])
    manifests = listing.where(name.isin(*_MANIFESTS)).select("root_no", F.col("dir").alias("at"), table[name].alias("family"), named.alias("package")).where("package <> ''")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    family = F.when(suffix == ".go", "go").when(suffix == ".rs", "rust").when(suffix.isin(".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx"), "js")
    keyed = listing.withColumn("family", family)
    dirs = keyed.where("family IS NOT NULL").select("root_no", "dir", "family").distinct()
    steps = dirs.select("root_no", "dir", "family", F.posexplode(prefixes(F.col("dir"))).alias("depth", "at"))
    best = steps.join(manifests, ["root_no", "at", "family"]).groupBy("root_no", "dir", "family").agg(F.max_by(F.struct("at", "package"), "depth").alias("found"))
    return keyed.join(best, ["root_no", "dir", "family"], "left").select(*listing.columns, F.col("found.at").alias("package_dir"), F.col("found.package").alias("package"))


def tops_of(root: str) -> frozenset[str]:
    """Names that make a module local: entries of the root and of its src, also without .py."""
    out: set[str] = set()
    for folder in (root, os.path.join(root, "src")):
        if os.path.isdir(folder):
            for n in os.listdir(folder):
                out |= {n, n[:-3]} if n.endswith(".py") else {n}
    return frozenset(out)


def extract(listing: DataFrame, roots: list[str]) -> DataFrame:
    """Tagged rows of every file: occ (occurrences), def (declarations), file (its language). Each file is parsed once."""
    tops, names = [tops_of(r) for r in roots], root_names(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            rows: list[tuple] = []
            for root_no, folder, name, content, package_dir, package in zip(*(c.to_pylist() for c in batch.columns)):
                rel = f"{folder}/{name}" if folder else name
                path = f"{names[root_no]}/{rel}" if names[root_no] else rel
                text = decode(content or b"")
                language = detect(name, text)
                if language is None and (other := named(name)):
                    rows.append(("file", path, root_no, other) + (None,) * 9)
                found = EXTRACTORS[language](text, Context(path, rel, package_dir, package, tops[root_no])) if language else None
                if found is None:
                    continue
                rows.append(("file", path, root_no, language) + (None,) * 9)
                rows += [("occ", path, root_no, language, *o, None, None, None) for o in found.occurrences]
                rows += [("def", path, root_no, language, None, None, None, None, None, None, *d) for d in sorted(found.defs)]
            cols = list(zip(*rows)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])

    return listing.select("root_no", "dir", "name", "content", "package_dir", "package").mapInArrow(run, _ROWS)


def resources(listing: DataFrame) -> DataFrame:
    """Declarations (path, language, kind, k, v) of the configuration resources that script modules define.

    X.psm1 defines the FriendlyName that X.schema.mof beside it gives, else the name after DSC_ in its own.
    """
    module = F.lower("name").endswith(".psm1")
    stem = F.regexp_extract("name", r"(?s)^(.*)\.[^.]*$", 1)
    friendly = F.regexp_extract(F.make_valid_utf8(F.col("content").cast("string")), r'(?s)FriendlyName\("([^"]+)"', 1)
    schemas = listing.where(F.col("name").endswith(".schema.mof")).select("root_no", "dir", F.regexp_extract("name", r"(?s)^(.*)\.schema\.mof$", 1).alias("stem"), friendly.alias("friendly"))
    modules = listing.where(module).select("root_no", "dir", stem.alias("stem")).join(schemas, ["root_no", "dir", "stem"], "left")
    own = F.when(F.col("friendly") != "", F.col("friendly")).when(F.lower("stem").startswith("dsc_"), F.substring("stem", F.lit(5), F.length("stem")))
    return modules.select(F.col("dir").alias("path"), F.lit("powershell").alias("language"), F.lit("function").alias("kind"), F.lower(own).alias("k"), F.lit("").alias("v")).where("k <> ''")


def drop_own_includes(occurrences: DataFrame, listing: DataFrame) -> DataFrame:
    """Without includes of paths that the corpus has: any suffix of a file's path under the same root."""
    parts = F.split(F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    own = listing.select("root_no", F.explode(suffixes).alias("include")).distinct()
    cleaned = occurrences.withColumn("include", F.regexp_replace("include", r"^(\./)+", ""))
    return cleaned.join(own, ["root_no", "include"], "left_anti")


def workspace_specifiers(listing: DataFrame) -> DataFrame:
    """root_no, spec of the module names that package.json and tsconfig*.json files define; a spec may hold `*`."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    at = lambda path: F.get_json_object(text, path)
    keys = lambda path: F.coalesce(F.json_object_keys(at(path)), F.array().cast("array<string>"))
    hidden = F.concat(F.lit("/"), F.col("dir")).contains("/.")
    package = listing.where((F.col("name") == "package.json") & ~hidden)
    name = at("$.name")
    exports = F.transform(F.filter(keys("$.exports"), lambda k: k.startswith("./")), lambda k: F.concat(name, F.lit("/"), F.substring(k, F.lit(3), F.length(k))))
    imports = F.filter(keys("$.imports"), lambda k: k.startswith("#"))
    of_package = package.select("root_no", F.explode(F.concat(F.when(name != "", F.concat(F.array(name), exports)).otherwise(F.array().cast("array<string>")), imports)).alias("spec"))
    config = listing.where(F.col("name").startswith("tsconfig") & F.col("name").endswith(".json") & ~hidden)
    return of_package.unionByName(config.select("root_no", F.explode(keys("$.compilerOptions.paths")).alias("spec"))).where("spec <> ''").distinct()


def drop_workspace_modules(occurrences: DataFrame, listing: DataFrame) -> DataFrame:
    """Without imports of, and calls into, modules that the workspace names itself (JavaScript and its dialects)."""
    script = F.col("language").isin("javascript", "typescript", "tsx")
    specs = workspace_specifiers(listing)
    used = occurrences.where(script & (F.col("module") != "")).select("root_no", "module").distinct()
    exact = used.join(specs.select("root_no", F.col("spec").alias("module")), ["root_no", "module"], "left_semi")
    wild = specs.where(F.col("spec").contains("*"))
    shape = F.concat(F.lit("(?s)^\\Q"), F.replace(F.col("spec"), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))
    # Few patterns meet the distinct module names of their own root only.
    matched = used.join(wild.select("root_no", shape.alias("shape")), "root_no").where(F.expr("module rlike shape")).select("root_no", "module")
    own = exact.unionByName(matched).distinct().withColumn("own", F.lit(True))
    return occurrences.join(own, ["root_no", "module"], "left").where(~(script & F.coalesce("own", F.lit(False)))).drop("own")


class IOReport:
    """version 3: the root paths, and per file its symbols with kinds and lines."""

    def __init__(self, root: str, rows: list[dict]):
        self.root, self.rows = root, rows

    def to_dict(self) -> dict:
        keep = ("language", "module", "symbol", "kinds", "lines")
        return {"version": 3, "root": self.root, "files": [{"path": r["path"], "symbols": [{k: s[k] for k in keep} for s in r["symbols"]]} for r in self.rows]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2) + "\n"

    def to_text(self) -> str:
        blocks = []
        for r in self.rows:
            lines = [r["path"]]
            for s in r["symbols"]:
                name = ".".join(x for x in (s["module"], s["symbol"]) if x)
                lines.append(f"  {','.join(s['kinds'])}  {s['language']}  {name}  {','.join(map(str, s['lines']))}")
            blocks.append("\n".join(lines))
        return "\n\n".join(blocks) + "\n" if blocks else ""


def scan_io(spark: SparkSession, *roots: str, ignore: bool = True, classifier: Callable[[DataFrame], DataFrame] | None = None, log: bool = True) -> IOReport:
    """The I/O report of one or several roots. classifier: distinct symbols -> language, module, symbol, io, kinds; the fixed table by default."""
    say = lambda *x: log and print(*x, file=sys.stderr, flush=True)
    paths = [os.path.realpath(r) for r in roots]
    unique = list(dict.fromkeys(paths))
    say("walk")
    listing = read_tree(spark, unique, ignore, "code").where("fate = 'file'").drop("fate", "size", "root").persist()
    say("walk", listing.count())
    say("parse")
    rows = extract(nearest_packages(listing), unique).persist()
    if log:
        for r in rows.where("type = 'file'").select("path", "language").orderBy("path").toLocalIterator():
            say(r["path"], r["language"])
    occurrences = rows.where("type = 'occ'").select("path", "root_no", "language", "module", "symbol", "line", "skips_function", "owner", "include")
    occurrences = drop_workspace_modules(drop_own_includes(occurrences, listing), listing)
    occurrences = drop_unused_modules(occurrences).drop("root_no", "include")
    defs = rows.where("type = 'def'").select("path", "language", "kind", "k", "v").unionByName(resources(listing))
    left = without_internal(occurrences, defs).persist()
    symbols = left.select("language", "module", "symbol").distinct()
    say("filter", symbols.count())
    say("classify")
    labels = known(label(symbols)) if classifier is None else classifier(symbols)
    found = [r.asDict(True) for r in by_file(left, labels).collect()]
    say("report", sum(len(r["symbols"]) for r in found))
    for df in (left, rows, listing):
        df.unpersist()
    return IOReport("\n".join(paths), found)
