"""Dropping the names that a corpus declares itself: every rule as an equi-join on exploded candidate keys.

occurrences: path, language, module, symbol, line, skips_function, owner. defs: path, language, kind, k, v with kind
function, scope, source or alias; a member's key is its module, a NUL and its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.closure import closure

NUL = "\0"
# Languages that share function names, and languages that share types.
FUNCTION_GROUPS = {"c": "c", "cpp": "c", "php": "php", "powershell": "powershell", "ruby": "ruby"}
SCOPE_GROUPS = {
    "java": "jvm", "kotlin": "jvm", "javascript": "js", "typescript": "js", "tsx": "js", "go": "go", "rust": "rust", "ruby": "ruby", "c": "c", "cpp": "c", "csharp": "csharp",
}


def _group(language: Column, groups: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[language]


def drop_unused_modules(occurrences: DataFrame) -> DataFrame:
    """A module's own row goes if the same file uses a symbol of the module."""
    used = F.max(F.col("symbol") != "").over(Window.partitionBy("path", "module"))
    return occurrences.withColumn("used", used).where((F.col("symbol") != "") | (F.col("module") == "") | ~F.col("used")).drop("used")


def scopes(defs: DataFrame) -> DataFrame:
    """grp, key of all declared types and members, Rust items also under the crate names that re-export them."""
    own = defs.where("kind = 'scope'").select(_group(F.col("language"), SCOPE_GROUPS).alias("grp"), F.col("k").alias("key")).where("grp IS NOT NULL").distinct()
    alias = defs.where("kind = 'alias'").select(F.col("k").alias("public"), F.col("v").alias("target")).distinct()
    # The crate is what stands before the first separator, or any longer path: prefixes are exploded and joined exactly.
    rust = own.where("grp = 'rust'")
    marks = F.transform(F.regexp_extract_all("key", F.lit(r"(?s)(\x00|::)"), F.lit(1)), lambda x: x)
    steps = rust.select("grp", "key", F.explode(F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1)))).alias("n"))
    head = F.array_join(F.slice(F.split("key", r"\x00|::"), 1, F.col("n")), "::")
    more = steps.withColumn("target", head).where("length(key) > length(target)").join(alias, "target")
    moved = more.select("grp", F.concat("public", F.expr("substring(key, length(target) + 1)")).alias("key"))
    return own.unionByName(moved).distinct()


def shell_functions(defs: DataFrame) -> DataFrame:
    """path, key: the functions each shell file can run, its own and those of the files it sources, however far."""
    shell = defs.where("language = 'shell'")
    files = shell.select("path").distinct()
    raw = shell.where("kind = 'source'").select("path", F.trim("k").alias("raw")).where("raw <> '' AND NOT startswith(raw, '/') AND NOT startswith(raw, '~')")
    base = F.filter(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: p != "")
    parts = F.filter(F.split("raw", "/"), lambda p: (p != "") & (p != "."))
    gone = F.array(F.lit("\\"))  # marks a path that leaves the roots; no file has this name
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) == 0), gone).when(p == "..", F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    target = F.array_join(F.aggregate(parts, base, step), "/")
    edges = raw.select(F.col("path").alias("src"), target.alias("dst")).join(files.select(F.col("path").alias("dst")), "dst")
    own = shell.where("kind = 'function'").select("path", F.col("k").alias("key"))
    reach = closure(edges.select("src", "dst"))
    seen = reach.join(own.withColumnRenamed("path", "dst"), "dst").select(F.col("src").alias("path"), "key")
    return own.unionByName(seen).distinct()


def without_internal(occurrences: DataFrame, defs: DataFrame) -> DataFrame:
    """The occurrences that no declaration of the corpus explains."""
    # An occurrence is told by all its columns: equal ones share their fate, and no hash can mistake one for another.
    rows = occurrences.withColumn("id", F.struct("path", "language", "module", "symbol", "line", "skips_function", F.coalesce("owner", F.lit("")).alias("owner")))
    powershell = F.col("language") == "powershell"
    symbol = F.when(powershell, F.lower("symbol")).otherwise(F.col("symbol"))
    functions = defs.where("kind = 'function'").select(_group(F.col("language"), FUNCTION_GROUPS).alias("grp"), F.when(powershell, F.lower("k")).otherwise(F.col("k")).alias("key")).where("grp IS NOT NULL").distinct()
    bare = rows.where("module = '' AND NOT skips_function")
    hit_function = bare.select("id", _group(F.col("language"), FUNCTION_GROUPS).alias("grp"), symbol.alias("key")).join(functions, ["grp", "key"], "left_semi").select("id")
    hit_shell = bare.where("language = 'shell'").select("id", "path", F.col("symbol").alias("key")).join(shell_functions(defs), ["path", "key"], "left_semi").select("id")
    m, s, nul = F.col("module"), F.col("symbol"), F.lit(NUL)
    member = lambda a, b: F.concat(a, nul, b)
    named, typed = (m != "") & (s != ""), (m != "") & (s == "")
    keys = F.array(
        F.when(F.col("owner") != "", member(F.col("owner"), s)),
        F.when((F.col("language") == "go") & named & s.contains("."), member(m, F.substring_index(s, ".", 1))),
        F.when(typed, m),
        F.when(named, member(m, s)),
        F.when(named, F.concat(m, F.lit("."), s)),
        F.when(named, member(F.concat(m, F.lit(".Companion")), s)),
        F.when(m.contains("."), member(F.regexp_extract(m, r"(?s)^(.*)\.", 1), F.substring_index(m, ".", -1))),
    )
    probes = rows.select("id", _group(F.col("language"), SCOPE_GROUPS).alias("grp"), F.explode(F.array_compact(keys)).alias("key"))
    hit_scope = probes.join(scopes(defs), ["grp", "key"], "left_semi").select("id")
    return rows.join(hit_function.unionByName(hit_shell).unionByName(hit_scope).distinct(), "id", "left_anti").drop("id")
