"""Transitive closure of a directed edge table that may hold cycles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where it is unset and the session runs on this machine alone."""
    context = df.sparkSession.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here."""
    path = f"{shared_folder(df)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of every pair with a path of one or more edges.

    Each round joins only the pairs that the round before was the first to find with the known ones, which doubles the
    length of the paths, and keeps what is new. Every round is written out and older ones are deleted.
    """
    known = fresh = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "closure")
    while True:
        further = fresh.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")).distinct()
        found = written(further.join(known, ["src", "dst"], "left_anti"), "closure")
        if found.isEmpty():
            forget(found)
            return known
        grown = written(known.unionByName(found), "closure")
        forget(known)
        if fresh is not known:
            forget(fresh)
        known, fresh = grown, found
