"""From labelled occurrences to the report's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.label_table import KINDS
from quarry.operators.labels import KEY


def qualified(module: Column, symbol: Column) -> Column:
    return F.array_join(F.filter(F.array(module, symbol), lambda x: x != ""), ".")


def kind_rank(kinds: Column) -> Column:
    """Sorts as the kinds are listed; an unknown kind comes last."""
    order = F.array(*map(F.lit, KINDS))
    return F.transform(kinds, lambda k: F.when(F.array_position(order, k) > 0, F.array_position(order, k) - 1).otherwise(len(KINDS)).cast("int"))


def lines_by_file(occurrences: DataFrame, labels: DataFrame) -> DataFrame:
    """path, language, module, symbol, kinds, lines (sorted, distinct) of everything that does I/O."""
    io = occurrences.join(labels.where("io"), KEY)
    return io.groupBy("path", *KEY).agg(F.first("kinds").alias("kinds"), F.array_sort(F.collect_set("line")).alias("lines"))


def files(occurrences: DataFrame, labels: DataFrame) -> DataFrame:
    """path, symbols: one row per file, its symbols by kind, language, module and name; rows by path."""
    entry = F.struct(kind_rank(F.col("kinds")).alias("rank"), *KEY, "kinds", "lines")
    return lines_by_file(occurrences, labels).groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("symbols")).orderBy("path")
