"""First-match labelling of symbols: every symbol's probes in order, joined with the table; the first that hits decides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.label_table import CIM, POWERSHELL_NOT_IO, WINDOWS_NETWORK, label_table

KEY = ["language", "module", "symbol"]


def probes(module: str, symbol: str) -> list[tuple[str, str, bool]]:
    """(module, symbol, whole): what to look up, in order. whole: only a module that is listed as a whole."""
    out: list[tuple[str, str, bool]] = []
    while "::" in module:
        parent, _, name = module.rpartition("::")
        out += [(module, symbol, False), (parent, name, False), (parent, "", True)]
        module, symbol = parent, f"{name}.{symbol}" if symbol else name
    while True:
        out.append((module, symbol, False))
        if "." not in symbol:
            return out + [(module, "", True)] * bool(symbol)
        head, _, tail = symbol.partition(".")
        longer = f"{module}.{head}" if module else head
        out += [(longer, tail, False), (module, symbol.rsplit(".", 1)[1], False)]
        module, symbol = longer, tail


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[tuple] = []
        for language, module, symbol in zip(*(c.to_pylist() for c in batch.columns)):
            fold = str.casefold if language == "powershell" else str
            made.append((language, module, symbol, 0, fold(module), fold(symbol), False))
            made += [(language, module, symbol, n, fold(m), fold(s), w) for n, (m, s, w) in enumerate(probes(module, symbol), 2)]
        cols = list(zip(*made)) or [()] * 7
        types = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 2 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*KEY, "ord", "m", "s", "whole_only"])


def label(symbols: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """language, module, symbol (distinct), io, kinds; io and kinds are null where nothing is known."""
    spark = symbols.sparkSession
    distinct = symbols.select(*KEY).distinct()
    powershell = F.col("language") == "powershell"
    table = (table if table is not None else label_table(spark)).select(
        F.col("language").alias("tl"), F.when(powershell, F.lower("module")).otherwise(F.col("module")).alias("m"), F.when(powershell, F.lower("symbol")).otherwise(F.col("symbol")).alias("s"), "kinds", "whole"
    )
    asked = distinct.mapInArrow(_probe_rows, "language string, module string, symbol string, ord int, m string, s string, whole_only boolean")
    hits = asked.join(F.broadcast(table), (F.col("language") == F.col("tl")) & (asked["m"] == table["m"]) & (asked["s"] == table["s"]) & (~F.col("whole_only") | F.col("whole")))
    first = hits.groupBy(*KEY).agg(F.min(F.struct("ord", "kinds")).alias("hit"))
    out = distinct.join(first, KEY, "left")
    folded = F.lower("symbol")
    by_rule = powershell & (folded.isin(*CIM) | folded.rlike(WINDOWS_NETWORK))
    not_io = powershell & folded.isin(*POWERSHELL_NOT_IO)
    kinds = F.when(not_io, F.array().cast("array<string>")).when(F.col("hit.ord") == 0, F.col("hit.kinds")).when(by_rule, F.array(F.lit("network"))).otherwise(F.col("hit.kinds"))
    return out.select(*KEY, kinds.alias("kinds")).select(*KEY, (F.size("kinds") > 0).alias("io"), "kinds").select(*KEY, F.when(F.col("kinds").isNotNull(), F.col("io")).alias("io"), "kinds")


def known(labels: DataFrame) -> DataFrame:
    """Labels with the unknown ones as not I/O."""
    return labels.select(*KEY, F.coalesce("io", F.lit(False)).alias("io"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
