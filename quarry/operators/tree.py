"""The directory abstract: directories with a manifest and their ancestors stay open, every other subtree is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fileclass import classify


def prefixes(path: Column) -> Column:
    """The path's ancestors and itself, shortest first; the empty path is the root and is first."""
    parts = F.split(path, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), own))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def join_path(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def ordered_counts(pairs: Column) -> Column:
    """array<struct<name, n>> with the greatest n first, equal ones by name."""
    return F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct((-p["n"]).alias("n"), p["name"].alias("name")))), lambda p: F.struct(p["name"].alias("name"), (-p["n"]).alias("n")))


def classified(tree: DataFrame) -> DataFrame:
    """root_no, dir, name, kind, label of the files in a tree listing."""
    files = tree.where("fate = 'file'")
    kind, label = classify(F.col("name"), join_path(F.col("dir"), F.col("name")), F.col("content"))
    return files.select("root_no", "dir", "name", kind.alias("kind"), label.alias("label"))


def spine(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """root_no, dir of every open directory: roots, directories with a manifest, and their ancestors."""
    marked = entries.where("kind = 'marker'").select("root_no", "dir").distinct()
    return marked.select("root_no", F.explode(prefixes(F.col("dir"))).alias("dir")).unionByName(roots.select("root_no", F.lit("").alias("dir"))).distinct()


def summarize(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row per open directory and per collapsed one.

    entries: root_no, dir, name, kind, label. dirs: root_no, dir, fate (enter | skip), roots included. Result: root_no,
    path, open, markers, build, files (ordered counts), file_count, skipped, directories, depth. Each collapsed row sums
    its whole subtree, in one aggregation over the directory's topmost closed ancestor.
    """
    opened = spine(entries, dirs.select("root_no").distinct())
    # The topmost closed ancestor of every directory that is not open: one row per directory and prefix, then the shortest.
    steps = dirs.select("root_no", "dir", "fate", F.posexplode(prefixes(F.col("dir"))).alias("at", "prefix"))
    closed = steps.join(opened.withColumnRenamed("dir", "prefix"), ["root_no", "prefix"], "left_anti")
    tops = closed.groupBy("root_no", "dir", "fate").agg(F.min_by("prefix", "at").alias("top"))
    placed = dirs.join(tops, ["root_no", "dir", "fate"], "left")
    # A skipped directory right below an open one is named there; deeper ones only count.
    inner = placed.where("top IS NOT NULL AND NOT (fate = 'skip' AND top = dir)")
    shape = inner.groupBy("root_no", F.col("top").alias("path")).agg(F.sum(F.when(F.col("dir") != F.col("top"), 1).otherwise(0)).alias("directories"), F.max(depth(F.col("dir")) - depth(F.col("top"))).alias("depth"))
    home = placed.where("fate = 'enter'").select("root_no", "dir", F.coalesce("top", "dir").alias("path"), F.col("top").isNull().alias("open"))
    files = entries.join(home, ["root_no", "dir"])
    below = F.when(F.col("open") | (F.col("dir") == F.col("path")), F.col("name")).otherwise(F.concat(F.expr("substring(dir, length(path) + 2)"), F.lit("/"), F.col("name")))
    counts = files.where("kind = 'file'").groupBy("root_no", "path", "label").agg(F.count("*").alias("n"))
    counts = counts.groupBy("root_no", "path").agg(ordered_counts(F.collect_list(F.struct(F.col("label").alias("name"), "n"))).alias("files"), F.sum("n").alias("file_count"))
    names = files.groupBy("root_no", "path").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "marker") & F.col("open"), F.col("name")))).alias("markers"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "build", below))).alias("build"),
    )
    skipped = placed.where("fate = 'skip' AND top = dir").select("root_no", F.regexp_replace("dir", r"/?[^/]*$", "").alias("path"), F.regexp_extract("dir", r"[^/]*$", 0).alias("name"))
    skipped = skipped.groupBy("root_no", "path").agg(F.array_sort(F.collect_list("name")).alias("skipped"))
    out = home.select("root_no", "path", "open").distinct()
    for part in (names, counts, skipped, shape):
        out = out.join(part, ["root_no", "path"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "root_no", "path", "open", F.coalesce("markers", none).alias("markers"), F.coalesce("build", none).alias("build"), F.coalesce("files", F.array().cast("array<struct<name:string,n:bigint>>")).alias("files"),
        F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"), F.coalesce("skipped", none).alias("skipped"),
        F.coalesce("directories", F.lit(0)).cast("long").alias("directories"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
    )
