"""Token counts kept as additive totals that batches of changes update.

A batch holds inserts, deletes and revised counts of (doc_id, tokenizer version). Against the ledger of current counts
each becomes signed rows: +new for an insert, -old for a delete, -old and +new for a revision (whose source or language
may change too). The signed rows, summed by source, language and tokenizer version, are the batch's delta; the totals
after a batch are those before it plus its delta, one small table a commit.

The ledger is cut into buckets by a hash of its key. A batch reads and rewrites the buckets that its keys fall into and no
other. A commit writes its buckets, delta and totals under a folder of its own and then, last, a numbered marker that
says where each bucket and the totals now are. Markers are created exclusively: of two writers one gets the number, the
other starts again from the new state. Only what a marker names counts, so a commit that broke off leaves no trace in
any result, and a batch id that a marker names is not applied again. Nothing that an earlier marker names is changed or
deleted by a commit: tables read before it stay readable until vacuum() is called.

Defined cases: of several changes to one document and version in a batch the one with the highest `seq` holds (equal
ones: the greatest by op, source, language and count, nulls least); deleting what is not there is nothing; inserting what
is there is a revision; a null text has no tokens (but an end, where the tokenizer counts one); null source or lang are
groups of their own; rows with a null doc_id or version cannot be told apart and are ignored; an empty batch commits an
empty delta; batch ids are any strings; texts of any length are counted in one pass; columns besides those named are not
read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import cut, drop_table, fresh_path

CHANGES = "seq bigint, op string, doc_id bigint, version string, source string, lang string, n_tokens bigint"
#: Buckets of a ledger, fixed when its first batch is committed: so many that one, of some 10 million rows, is quickly rewritten.
BUCKETS = 64
_KEY = ["doc_id", "version"]
_GROUP = ["source", "lang", "version"]
_LEDGER = "doc_id bigint, version string, source string, lang string, n_tokens bigint"
_TOTALS = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


def expressions() -> dict[str, Column]:
    """Tokenizer versions that are column expressions: words between white space, and the bytes of UTF-8 as byte-level models read them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"words-1": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), "bytes-1": F.octet_length(text)}


def counted(docs: DataFrame, *versions: str) -> DataFrame:
    """doc_id, version, source, lang, n_tokens under each version: one of words-1 and bytes-1, or word-bpe-49k, the merges that op8 encodes with."""
    out = None
    plain = {v: c for v, c in expressions().items() if v in versions}
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    if plain:
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), c.cast("long").alias("n_tokens")) for v, c in plain.items()])).alias("each")
        out = docs.select(*kept, each).select("doc_id", "each.version", "source", "lang", "each.n_tokens")
    for v in versions:
        if v == "word-bpe-49k":
            # The encoder carries one id column: all that is kept goes through it as one string.
            ids = docs.select(F.to_json(F.struct(*kept)).alias("doc_id"), F.col("text").alias("text"))
            row = F.from_json("doc_id", "doc_id bigint, source string, lang string")
            made = bpe.encode(ids).select(row.alias("r"), "n_tokens").select("r.doc_id", F.lit(v).alias("version"), "r.source", "r.lang", F.col("n_tokens").cast("long").alias("n_tokens"))
            out = made if out is None else out.unionByName(made)
        elif v not in plain:
            raise ValueError(f"no tokenizer version {v}")
    return out


def changes(rows: DataFrame, op: str, seq: int = 0) -> DataFrame:
    have = set(rows.columns)
    cols = {"seq": F.lit(seq).cast("long"), "op": F.lit(op)} | {c: F.col(c) if c in have else F.lit(None) for c in ("doc_id", "version", "source", "lang", "n_tokens")}
    kinds = dict(f.split() for f in CHANGES.split(", "))
    return rows.select(*[v.cast(kinds[k]).alias(k) for k, v in cols.items()])


class Rollup:
    """Totals under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._read: dict[str, dict] = {}

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _list(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _markers(self) -> list[dict]:
        """What the markers say, in the order of their numbers; each is read once. One still being written is no commit yet."""
        out = []
        for name in self._list(f"{self.path}/commits"):
            if name not in self._read:
                fs, where = self._fs(f"{self.path}/commits/{name}")
                stream = fs.open(where)
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                try:
                    self._read[name] = json.loads(text)
                except ValueError:
                    break
            out.append(self._read[name])
        return out

    def _last(self) -> dict:
        found = self._markers()
        return found[-1] if found else {"number": -1, "n_buckets": self.buckets, "buckets": {}, "totals": None}

    def committed(self) -> list[str]:
        """Batch ids in the order of their commits."""
        return [m["batch"] for m in self._markers()]

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The current counts: doc_id, version, source, lang, n_tokens."""
        return self._table([f"{self.path}/{p}" for p in self._last()["buckets"].values()], _LEDGER)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: sums of the committed deltas, groups without documents left out."""
        at = self._last()["totals"]
        return self._table([f"{self.path}/{at}"] if at else [], _TOTALS)

    def deltas(self) -> DataFrame:
        """The signed sums of every commit, with its number."""
        out = self.spark.createDataFrame([], f"number bigint, {_TOTALS}")
        for m in self._markers():
            out = out.unionByName(self._table([f"{self.path}/{m['delta']}"], _TOTALS).select(F.lit(m["number"]).cast("long").alias("number"), "*"))
        return out

    def apply(self, batch_id: str, batch: DataFrame, tries: int = 20) -> bool:
        """Commit a batch of CHANGES; False if it was committed before."""
        for _ in range(tries):
            if batch_id in self.committed():
                return False
            before = self._last()
            marker = self._write(batch_id, batch, before)
            if self._mark(marker):
                return True
        raise RuntimeError(f"{tries} other writers were faster")

    def _write(self, batch_id: str, batch: DataFrame, before: dict) -> dict:
        number = before["number"] + 1
        folder = f"data/{number:09d}-{hashlib.sha256(batch_id.encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64(*_KEY), F.lit(before["n_buckets"])).cast("int")
        told = batch.where("doc_id IS NOT NULL AND version IS NOT NULL").groupBy(*_KEY).agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("new"))
        told = cut(told.withColumn("bucket", bucket), "rollup-changes")
        touched = sorted(r[0] for r in told.select("bucket").distinct().collect())  # at most as many as buckets
        held = [before["buckets"][str(b)] for b in touched if str(b) in before["buckets"]]
        old = self._table([f"{self.path}/{p}" for p in held], _LEDGER).select(*_KEY, F.struct("source", "lang", "n_tokens").alias("old"))
        both = told.drop("bucket").join(old, _KEY, "full")
        kept = F.when(F.col("new").isNull(), F.col("old")).when(F.col("new.op") != "delete", F.struct("new.source", "new.lang", "new.n_tokens"))
        # Signed rows ride along with the next state, so that one join makes both.
        staged = cut(both.select(*_KEY, "old", F.col("new").isNotNull().alias("changed"), kept.alias("kept")), "rollup-staged")
        state = staged.where("kept IS NOT NULL").select(*_KEY, "kept.source", "kept.lang", "kept.n_tokens").withColumn("bucket", bucket)
        state.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/ledger")
        signed = lambda rows, col, sign: staged.where(rows).select(f"{col}.source", f"{col}.lang", "version", F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(f"{col}.n_tokens", F.lit(0))).alias("n_tokens"))
        sums = lambda df: df.groupBy(*_GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta = sums(signed("changed AND kept IS NOT NULL", "kept", 1).unionByName(signed("changed AND old IS NOT NULL", "old", -1)))
        delta.write.parquet(f"{self.path}/{folder}/delta")
        earlier = self._table([f"{self.path}/{before['totals']}"] if before["totals"] else [], _TOTALS)
        sums(earlier.unionByName(self._table([f"{self.path}/{folder}/delta"], _TOTALS))).where("n_docs <> 0").write.parquet(f"{self.path}/{folder}/totals")
        for table in (told, staged):
            drop_table(table)
        now = {n.partition("=")[2]: f"{folder}/ledger/{n}" for n in self._list(f"{self.path}/{folder}/ledger") if n.startswith("bucket=")}
        others = {b: p for b, p in before["buckets"].items() if int(b) not in set(touched)}
        return {"number": number, "batch": batch_id, "n_buckets": before["n_buckets"], "buckets": others | now, "totals": f"{folder}/totals", "delta": f"{folder}/delta"}

    def _mark(self, marker: dict) -> bool:
        """Create the marker; False if another writer has this number."""
        fs, where = self._fs(f"{self.path}/commits/{marker['number']:09d}")
        try:
            stream = fs.create(where, False)
        except Exception as error:
            if fs.exists(where):
                return False
            raise error
        stream.write(bytearray(json.dumps(marker).encode()))
        stream.close()
        return True

    def vacuum(self) -> None:
        """Delete the buckets and totals that the last marker does not name; deltas and markers stay. Tables read before may no longer be readable."""
        last, marks = self._last(), self._markers()
        live = {*last["buckets"].values(), last["totals"]}
        for m in marks[:-1]:
            for path in {*m["buckets"].values(), m["totals"]} - live:
                fs, where = self._fs(f"{self.path}/{path}")
                fs.delete(where, True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under two tokenizer versions; every count of one revised (an end token more, an unknown language named); those labelled toxic deleted from both; every batch sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    revised = counted(docs, "bytes-1").withColumn("n_tokens", F.col("n_tokens") + 1).withColumn("lang", F.coalesce("lang", F.lit("und")))
    batches = {
        "load": changes(counted(docs, "words-1", "bytes-1"), "insert"),
        "end tokens": changes(revised, "revise"),
        "toxic": changes(toxic.withColumn("version", F.explode(F.array(F.lit("words-1"), F.lit("bytes-1")))), "delete"),
    }
    for _ in range(2):
        for name, batch in batches.items():
            rollup.apply(name, batch)
    return rollup.totals()


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
  WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), n AS (
  SELECT doc_id, source, lang, 'words-1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL
  SELECT doc_id, source, coalesce(lang, 'und'), 'bytes-1', strlen(t) + 1 FROM d
), one AS (
  SELECT DISTINCT ON (doc_id, version) * FROM n ORDER BY doc_id, version, source DESC NULLS LAST, lang DESC NULLS LAST, n DESC
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM one GROUP BY ALL
"""
