"""The operators' relational cores on the given tables, each with DuckDB SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry
from quarry.functions.fileclass import SUFFIXES, language_of
from quarry.functions.label_table import POWERSHELL_NOT_IO, label_table, rows
from quarry.operators.closure import closure
from quarry.operators.decls import drop_unused_modules, without_internal
from quarry.operators.labels import known, label
from quarry.operators.report import lines_by_file
from quarry.operators.tree import ordered_counts, prefixes, summarize
from quarry.plans.cascade import batched, cache_key
from quarry.plans.io_report import drop_own_includes, nearest_packages, workspace_specifiers

PATHS_SQL = r"""
WITH u AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, string_split(regexp_replace(regexp_replace(url, '^https?://[^/?#]*/?', ''), '[?#].*$', ''), '/') AS raw FROM pages
), p AS (SELECT page_id, host, list_filter(raw, lambda x: x <> '') AS parts FROM u)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, parts of every page's URL path, without empty parts."""
    url = F.col("url")
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]*/?", ""), r"[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^https?://([^/?#]*)", 1).alias("host"), F.filter(F.split(path, "/"), lambda x: x != "").alias("parts"))


def _query(sql: str | None = None):
    def keep(f):
        registry.QUERIES[f.__name__] = f
        if sql:
            registry.ORACLES[f.__name__] = sql
        return f

    return keep


@_query(
    PATHS_SQL
    + """, d AS (SELECT DISTINCT host, array_to_string(parts[1:len(parts) - 1], '/') AS dir, parts[1:len(parts) - 1] AS q FROM p)
SELECT DISTINCT host, array_to_string(q[1:i], '/') AS dir FROM (SELECT host, q, unnest(range(0, len(q) + 1)) AS i FROM d)"""
)
def path_spine(spark, sf_dir):
    """Every directory of the URL tree with its ancestors."""
    dirs = _paths(spark, sf_dir).select("host", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/").alias("dir")).distinct()
    return dirs.select("host", F.explode(prefixes(F.col("dir"))).alias("dir")).distinct()


@_query(
    PATHS_SQL
    + """, f AS (SELECT host, parts[1:len(parts) - 1] AS q FROM p), d AS (SELECT DISTINCT host, q[1:i] AS q FROM (SELECT host, q, unnest(range(1, len(q) + 1)) AS i FROM f)),
n AS (SELECT host, q[1] AS top, count(*) AS files FROM f WHERE len(q) > 0 GROUP BY 1, 2),
s AS (SELECT host, q[1] AS top, count(*) - 1 AS directories, CAST(max(len(q)) - 1 AS INTEGER) AS depth FROM d GROUP BY 1, 2)
SELECT s.host, s.top, coalesce(n.files, 0) AS files, s.directories, s.depth FROM s LEFT JOIN n USING (host, top)
UNION ALL SELECT host, '', count(*) FILTER (len(q) = 0), 0, 0 FROM f GROUP BY 1"""
)
def subtree_rollup(spark, sf_dir):
    """The abstract of each host's URL tree: files below every top directory, directories and depth."""
    paths = _paths(spark, sf_dir).withColumn("dir", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/"))
    entries = paths.select(F.col("host").alias("root_no"), "dir", F.element_at("parts", -1).alias("name"), F.lit("file").alias("kind"), F.lit("other").alias("label"))
    dirs = paths.select(F.col("host").alias("root_no"), F.explode(prefixes(F.col("dir"))).alias("dir")).distinct().withColumn("fate", F.lit("enter"))
    return summarize(entries, dirs).select(F.col("root_no").alias("host"), F.col("path").alias("top"), F.col("file_count").alias("files"), "directories", "depth")


_CASES = " ".join(f"WHEN '{s}' THEN '{name}'" for name, all_ in SUFFIXES.items() for s in all_.split())


@_query(
    PATHS_SQL
    + f", n AS (SELECT page_id, coalesce(parts[len(parts)], '') || CASE page_id % 5 WHEN 0 THEN '.PY' WHEN 1 THEN '.d.ts' WHEN 2 THEN '.weird' WHEN 3 THEN '' ELSE '.hpp' END AS name FROM p) "
    + f"SELECT page_id, name, CASE lower(regexp_extract(name, '^.+([.][^.]*)$', 1)) {_CASES} ELSE 'other' END AS label FROM n"
)
def suffix_label(spark, sf_dir):
    """The language label of file names made from URLs."""
    n = F.col("page_id") % 5
    ending = F.when(n == 0, ".PY").when(n == 1, ".d.ts").when(n == 2, ".weird").when(n == 3, "").otherwise(".hpp")
    named = _paths(spark, sf_dir).select("page_id", F.concat(F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("")), ending).alias("name"))
    return named.select("page_id", "name", language_of(F.col("name")).alias("label"))


@_query(
    PATHS_SQL
    + """, f AS (SELECT page_id, host, parts[1:len(parts) - 1] AS q FROM p), m AS (SELECT host, q, min(page_id) AS page FROM f JOIN pages USING (page_id) WHERE contains(url, '?') GROUP BY 1, 2),
a AS (SELECT page_id, host, q[1:i] AS q, i FROM (SELECT page_id, host, q, unnest(range(0, len(q) + 1)) AS i FROM f))
SELECT f.page_id, array_to_string(r.q, '/') AS package_dir, 'p' || r.page AS package FROM f LEFT JOIN (SELECT a.page_id, arg_max(m.page, a.i) AS page, arg_max(m.q, a.i) AS q FROM a JOIN m ON a.host = m.host AND a.q = m.q GROUP BY 1) r USING (page_id)"""
)
def nearest_ancestor(spark, sf_dir):
    """nearest_packages over the URL trees: pages are scripts, and a folder with a queried page has a package.json named after the first."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").contains("?").alias("asked"))
    where = _paths(spark, sf_dir).select("page_id", F.col("host").alias("root_no"), F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/").alias("dir"))
    scripts = where.select("root_no", "dir", F.lit("x.ts").alias("name"), F.lit(b"").alias("content"), "page_id")
    named = where.join(pages.where("asked"), "page_id").groupBy("root_no", "dir").agg(F.min("page_id").alias("page"))
    content = F.concat(F.lit('{"name": "p'), F.col("page").cast("string"), F.lit('"}')).cast("binary")
    listing = scripts.unionByName(named.select("root_no", "dir", F.lit("package.json").alias("name"), content.alias("content"), F.lit(None).cast("long").alias("page_id")))
    return nearest_packages(listing).where("name = 'x.ts'").select("page_id", "package_dir", "package")


@_query(
    PATHS_SQL
    + """, s AS (SELECT DISTINCT host, array_to_string(parts[i:len(parts)], '/') AS suffix FROM (SELECT host, parts, unnest(range(1, len(parts) + 1)) AS i FROM p JOIN pages USING (page_id) WHERE contains(url, '#') AND len(parts) > 0)),
o AS (SELECT page_id, host, array_to_string(parts[greatest(1, len(parts) - page_id % 3):len(parts)], '/') AS include FROM p)
SELECT page_id, o.host, include FROM o LEFT JOIN s ON o.host = s.host AND o.include = s.suffix WHERE s.suffix IS NULL"""
)
def path_suffix_index(spark, sf_dir):
    """drop_own_includes: every page includes the end of its path; the corpus has the pages whose URL holds a fragment."""
    paths = _paths(spark, sf_dir)
    size = F.size("parts")
    first = F.greatest(F.lit(1), size - (F.col("page_id") % 3).cast("int"))
    dots = F.when(F.col("page_id") % 2 == 0, "./").otherwise("")
    includes = paths.select("page_id", F.col("host").alias("root_no"), F.concat(dots, F.array_join(F.slice("parts", first, size), "/")).alias("include"))
    own = paths.join(_table(spark, sf_dir, "pages").where(F.col("url").contains("#")).select("page_id"), "page_id").where(size > 0)
    listing = own.select(F.col("host").alias("root_no"), F.array_join(F.slice("parts", 1, size - 1), "/").alias("dir"), F.element_at("parts", -1).alias("name"))
    return drop_own_includes(includes, listing).select("page_id", F.col("root_no").alias("host"), "include")


@_query(
    """SELECT d.doc_id FROM documents d WHERE
NOT (coalesce(lang, '') = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id))
AND NOT (coalesce(lang, '') IN ('fr', 'es') AND EXISTS (SELECT 1 FROM labels l WHERE l.quality = 1 AND (l.doc_id = d.doc_id OR l.doc_id = d.doc_id + 1 AND d.doc_id % 2 = 0)))"""
)
def exploded_key_anti_join(spark, sf_dir):
    """without_internal: English documents call a C function, German ones a PHP one, the others Java or Kotlin members; labels declare some."""
    lang, of = F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")
    jvm = lang.isin("fr", "es")
    language = F.when(lang == "en", "c").when(lang == "de", "php").when(lang == "fr", "java").when(lang == "es", "kotlin").otherwise("go")
    calls = _table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("d"), of).alias("path"), language.alias("language"), F.when(jvm, F.concat(F.lit("p.T"), of)).otherwise("").alias("module"), F.when(jvm, F.lit("run")).otherwise(F.concat(F.lit("f"), of)).alias("symbol"),
        F.lit(1).alias("line"), F.lit(False).alias("skips_function"), F.lit(None).cast("string").alias("owner"),
    )
    labels = _table(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    define = lambda rows, language, kind, key: rows.select(F.lit("x").alias("path"), F.lit(language).alias("language"), F.lit(kind).alias("kind"), key.alias("k"), F.lit("").alias("v"))
    member = lambda n: F.concat(F.lit("p.T"), n.cast("string"), F.lit("\0run"))
    good = labels.where("quality = 1")
    defs = define(labels.where("toxic = 1"), "cpp", "function", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).unionByName(define(good, "kotlin", "scope", member(F.col("doc_id"))))
    # The member of a companion object counts as its type's.
    companion = F.concat(F.lit("p.T"), (F.col("doc_id") - 1).cast("string"), F.lit(".Companion\0run"))
    return without_internal(calls, defs.unionByName(define(good.where("doc_id % 2 = 1"), "java", "scope", companion))).select("doc_id")


@_query("SELECT conv_id, turn, role FROM (SELECT *, bool_or(role <> 'user') OVER (PARTITION BY conv_id) AS used FROM conversations) WHERE role <> 'user' OR NOT used")
def unused_group_drop(spark, sf_dir):
    """drop_unused_modules: a conversation is a file that imports a module; a user's turn is the bare import, the others use it."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("conv_id").cast("string").alias("path"), F.lit("m").alias("module"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("symbol"))
    return drop_unused_modules(turns).select("conv_id", "turn", "role")


@_query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 50 AS src, l_suppkey % 50 AS dst FROM lineitem), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT src, dst FROM r"""
)
def transitive_closure(spark, sf_dir):
    """All pairs joined by a path in a cyclic graph of the residues of part and supplier keys."""
    edges = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"))
    return closure(edges)


_LISTED = [
    ("ECONOMY", "B1.C2", "filesystem", False), ("SMALL.B0", "C1", "network", False), ("LARGE", "C2", "process", False), ("STANDARD.B3", "", "database", True), ("SMALL", "C1", "service", False), ("MEDIUM.B2", "", "service", False), ("ECONOMY.B4", "", "network", True),
    ("ECONOMY.B4", "C0", "process", False),
]


@_query(
    f"""WITH t(m, s, kind, whole) AS (VALUES {", ".join(f"('{m}', '{s}', '{k}', {w})" for m, s, k, w in _LISTED)}),
p AS (SELECT DISTINCT p_type AS m, 'B' || p_partkey % 5 AS b, 'C' || p_partkey % 3 AS c FROM part)
SELECT m AS module, b || '.' || c AS symbol, coalesce((SELECT kind FROM t WHERE t.m = p.m AND t.s = b || '.' || c), (SELECT kind FROM t WHERE t.m = p.m || '.' || b AND t.s = c), (SELECT kind FROM t WHERE t.m = p.m AND t.s = c),
(SELECT kind FROM t WHERE t.m = p.m || '.' || b AND t.s = '' AND whole)) AS kind FROM p"""
)
def first_match_label(spark, sf_dir):
    """label with a table of its own: the first probe of a dotted name that is listed decides."""
    table = spark.createDataFrame([("python", m, s, [k], w) for m, s, k, w in _LISTED], "language string, module string, symbol string, kinds array<string>, whole boolean")
    n = lambda prefix, by: F.concat(F.lit(prefix), (F.col("p_partkey") % by).cast("string"))
    symbols = _table(spark, sf_dir, "part").select(F.lit("python").alias("language"), F.col("p_type").alias("module"), F.concat(n("B", 5), F.lit("."), n("C", 3)).alias("symbol"))
    return label(symbols, table).select("module", "symbol", F.try_element_at("kinds", F.lit(1)).alias("kind"))


@_query(
    """WITH s AS (SELECT DISTINCT coalesce(lang, '') AS language, coalesce(source, '') AS module, doc_id::VARCHAR AS symbol FROM documents), n AS (SELECT *, (row_number() OVER (PARTITION BY language ORDER BY module, symbol) - 1) // 30 AS batch FROM s)
SELECT language, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(module || '/' || symbol) AS first, max(module || '/' || symbol) AS last FROM n GROUP BY 1, 2"""
)
def batches_of_30(spark, sf_dir):
    """The cascade's batches of thirty names in each language, in order."""
    symbols = _table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("module"), F.col("doc_id").cast("string").alias("symbol")).distinct()
    spelled = F.transform("names", lambda n: F.concat(n["module"], F.lit("/"), n["symbol"]))
    return batched(symbols, 30).select("language", "batch", F.size("names").cast("long").alias("n"), F.array_min(spelled).alias("first"), F.array_max(spelled).alias("last"))


@_query("SELECT doc_id, sha256('3' || chr(0) || 'm' || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || doc_id::VARCHAR) AS cache_key FROM documents")
def cache_key_sha256(spark, sf_dir):
    """The label cache's key of every document taken as a name: SHA-256 of NUL-joined fields."""
    names = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("module"), F.col("doc_id").cast("string").alias("symbol"))
    return names.select("doc_id", cache_key("m").alias("cache_key"))


@_query("SELECT role, conv_id, array_to_string(list_sort(list(DISTINCT turn)), ',') AS turns FROM conversations WHERE role <> 'user' GROUP BY ALL")
def lines_by_group(spark, sf_dir):
    """lines_by_file: a conversation is a file, its roles are symbols, all but the user do I/O; their turns are the lines."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.lit("x").alias("language"), F.lit("").alias("module"), F.col("role").alias("symbol"), F.col("turn").alias("line"))
    labels = turns.select("language", "module", "symbol").distinct().select("*", (F.col("symbol") != "user").alias("io"), F.array(F.lit("network")).alias("kinds"))
    return lines_by_file(turns, labels).select(F.col("symbol").alias("role"), F.col("path").alias("conv_id"), F.array_join(F.transform("lines", lambda t: t.cast("string")), ",").alias("turns"))


@_query("SELECT source, string_agg(lang || ' x' || n, '  ' ORDER BY n DESC, lang) AS counts FROM (SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def ordered_language_counts(spark, sf_dir):
    """Counts of languages by source, the greatest first, equal ones by name."""
    n = _table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("none")).alias("name")).agg(F.count("*").alias("n"))
    ordered = n.groupBy("source").agg(ordered_counts(F.collect_list(F.struct("name", "n"))).alias("c"))
    return ordered.select("source", F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit(" x"), x["n"].cast("string"))), "  ").alias("counts"))


@_query("SELECT DISTINCT user_id, unnest(json_keys(props)) AS spec FROM events WHERE json_valid(props)")
def json_keys(spark, sf_dir):
    """workspace_specifiers: an event's properties are the path map of its user's tsconfig.json; text that is no JSON has none."""
    content = F.concat(F.lit('{"compilerOptions": {"paths": '), F.col("props"), F.lit("}}")).cast("binary")
    listing = _table(spark, sf_dir, "events").select(F.col("user_id").alias("root_no"), F.lit("").alias("dir"), F.lit("tsconfig.json").alias("name"), content.alias("content"))
    return workspace_specifiers(listing).select(F.col("root_no").alias("user_id"), "spec")


def _static_sql() -> str:
    """The fixed table as VALUES, with the rules for PowerShell names that go before and after it."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    listed = ", ".join(f"({', '.join(map(text, r))})" for r in rows())
    silent = ", ".join(map(text, POWERSHELL_NOT_IO))
    return f"SELECT language, module, symbol, kinds <> '' AS io, kinds FROM (SELECT language, module, symbol, CASE WHEN language = 'powershell' AND lower(symbol) IN ({silent}) THEN '' ELSE kind END AS kinds FROM (VALUES {listed}) AS t(language, module, symbol, kind))"


@_query(_static_sql())
def static_labels(spark, sf_dir):
    """The label of every name in the fixed table, looked up as a call would be."""
    table = label_table(spark)
    return known(label(table.select("language", "module", "symbol"))).select("language", "module", "symbol", "io", F.array_join("kinds", ",").alias("kinds"))
