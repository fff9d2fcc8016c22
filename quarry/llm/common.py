"""What the operators of this subpackage share: the shared folder, written tables, and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a folder of our own only where it is unset and all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over, rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: each goes when its write is over, not at some later collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def drop_table(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the map by which rows are told that may have one of a set of ids. All that is broadcast of the set: at most FILTER_BITS / 64 rows of 16 bytes.
FILTER_BITS = 1 << 24


def perhaps(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have one of ids in this column, the others, which surely have none).

    A bitmap of hashes, of the same size whatever the number of ids, is sent to the tasks; an exact join of the first
    part must follow. The more ids, the more rows the first part holds, in the end all of them.
    """
    slot, word, bits = (_free(df, n) for n in ("slot", "word", "bits"))
    hashed = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(slot) % 64).cast("int"))
    table = cut(ids.select(hashed.alias(slot)).groupBy(F.floor(F.col(slot) / 64).alias(word)).agg(F.bit_or(bit).alias(bits)), "filter")
    marked = df.withColumn(slot, hashed).withColumn(word, F.floor(F.col(slot) / 64)).join(F.broadcast(table), word, "left")
    hit = F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit) != 0
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose id is not among ids (one column of that name), as they were."""
    some, rest = perhaps(df, ids, column)
    return rest.unionByName(some.join(ids, column, "left_anti").select(*df.columns))


#: Bytes of one Arrow batch (beyond it only a single longer row). Batches live outside the heap and, decoded, in Python workers.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bucket_of(column: str, mod: int):
    """crc32 of the id written as text, modulo mod: how the contracts name their folds. A null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(0))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of text that are hashed at once (cut between words), and the longest word that is hashed in eights of bytes.
PIECE, LONG_WORD = 1 << 20, 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of raw, which starts with white space."""
    buf = np.frombuffer(raw + b"\n" + bytes(8), np.uint8)
    space = _SPACE[buf[:-8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, size = edge[0::2], edge[1::2] - edge[0::2]
    low = _LOWER[buf]
    eights = np.ndarray(len(low) - 7, np.dtype("<u8"), low, strides=(1,))
    out = mix(size.astype(np.uint64), 20)
    part = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        if at:
            part = part[size[part] > at]
        if not len(part):
            break
        out[part] = mix(out[part] ^ (eights[starts[part] + at] & _FIRST_BYTES[np.minimum(size[part] - at, 8)]), 21)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = low[starts[i] : starts[i] + size[i]]
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return out, starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, number of the first word of each text and one past the last).

    A word's bytes pass eight at a time through a bijective mixer that starts from their number, so words of up to eight
    bytes of one length never share a hash; others do with a chance of 2^-64 a pair, longer ones than LONG_WORD by
    BLAKE2. Texts are hashed in pieces of about PIECE bytes, so that memory beyond the text and its hashes is bounded
    (but for a single word longer than that).
    """
    out, count = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            begin = np.cumsum([1, *(len(p) + 1 for p in held)])
            h, starts = _hashed(b"\n" + b"\n".join(held))
            np.add.at(count, owner, np.diff(np.searchsorted(starts, begin)))
            out.append(h)
            held.clear()
            owner.clear()

    size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while at < len(raw) or not at:
            gap = _GAP.search(raw, at + PIECE) if len(raw) - at > PIECE else None
            end = gap.start() if gap else len(raw)
            held.append(raw[at:end])
            owner.append(i)
            size += end - at
            at = end + 1
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return np.concatenate(out), np.concatenate(([0], np.cumsum(count)))


def text_batches(batch: pa.RecordBatch, column: str, most: int = 1_000_000):
    """Slices of a batch whose texts have about `most` characters together, each as (offset, texts); one text is never split."""
    texts = batch.column(column).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]
