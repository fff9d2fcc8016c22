"""Language-model scoring with Katz backoff over bigrams: fit() writes the model's tables, score() evaluates texts with them.

The bigram counts are discounted by Good-Turing estimates (counts up to CUT; larger ones lose TAIL), the mass so freed
goes to words not seen after the history, in proportion to the add-one unigram model, with exact backoff weights:

    P(w | h) = c*(h, w) / c(h)                 if c(h, w) > 0
             = alpha(h) * P(w)                 otherwise; alpha(h) = 1 if h was never seen
    P(w)     = (c(w) + 1) / (N + V + 1)
    alpha(h) = (sum over seen w of c - c*) / c(h) / (1 - sum over seen w of P(w))

which sums to one over all known words and one unknown word, for every history.

Tables. `counts` holds the bigrams with their counts and the words with theirs, in buckets by word; `weights` holds each
history's alpha(h) * c(h), in buckets by history; `hot` the at most HOT most frequent words with their exact counts and
weights, and `meta` the sizes: only these two are sent to tasks. A row of the first two is one bucket's columns, as
typed numbers with a header that names their types, compressed; no row is code.

Fitting counts the bigrams of CHUNK tokens at a time before they are dealt. Scoring deals tokens, counted by bigram and
document, to the buckets, where they meet the counts one batch at a time; what backs off from a history that is not hot
goes on to the weights; a document's parts are then added up. Bigrams of a hot word are dealt by bigram instead of word,
and of one bigram no more than one row a document travels, so no bucket gets all tokens of a frequent word or pair.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as training; without training texts
every word is unknown; repeated rows are trained on and scored each; an empty table gives an empty table; a text of any
length is one chunk (some 100 bytes of memory a token); only doc_id and text are read, whatever other columns are called.
Words are told apart by 64-bit hashes. Documents should come from written tables: a task that is run again must meet the
rows it met before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, bucket_of, cut, drop_table, fresh_path, mix, release, shuffles_end, trim, word_hashes

CUT, TAIL = 5, 0.1
#: The most frequent words that are sent to all tasks (24 bytes each); with the start mark their numbers have 16 bits.
HOT = 50_000
#: Tokens that a mapper packs at once, and training tokens of a bucket.
CHUNK, PER_BUCKET = 1_000_000, 3_000_000
END, BOS = np.uint64(0xE4D0_0000_0000_0001), np.uint64(0xB050_0000_0000_0001)
_ROW = "kind string, key bigint, size bigint, columns binary"
_LOCAL = 22  # bits of a document's number in its chunk
_TYPE = re.compile(r"([<|][uif][1248])(\d+)")


def _pack(kind: str, key: int, *columns: np.ndarray) -> tuple:
    head = " ".join(f"{c.dtype.str}{len(c)}" for c in columns).encode() + b"\n"
    raw = head + b"".join(c.tobytes() for c in columns)
    return kind, key, len(raw), pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def _unpack(size: int, blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob, size, "zstd", asbytes=True)
    at = raw.index(b"\n") + 1
    out = []
    for kind, n in _TYPE.findall(raw[: at - 1].decode()):
        out.append(np.frombuffer(raw, np.dtype(kind), int(n), at))
        at += out[-1].nbytes
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "key", "size", "columns"])


def _batched(rows: Iterator[tuple], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > most:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by key, as (key, [(kind, size, columns)])."""
    now, held = None, []
    for kind, key, size, blob in _rows(batches):
        if key != now and held:
            yield now, held
            held = []
        now = key
        held.append((kind, size, blob))
    if held:
        yield now, held


def _small(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the numbers."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, whether found) of x in a sorted array."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    slot = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return slot, sorted_values[slot] == x


def _named(hot: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as three columns: which are hot, the numbers of these, the others as they are."""
    slot, found = _in(hot, x)
    return np.packbits(found), slot[found].astype(np.uint16), x[~found]


def _words(hot: np.ndarray, found: np.ndarray, slot: np.ndarray, others: np.ndarray) -> np.ndarray:
    found = np.unpackbits(found, count=len(slot) + len(others)).astype(bool)
    out = np.empty(len(found), np.uint64)
    out[found], out[~found] = hot[slot], others
    return out


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, history, text number) of all tokens: each text's words and its end."""
    words, first = word_hashes(texts)
    n = np.diff(first)
    ends = np.cumsum(n + 1) - 1
    token = np.empty(len(words) + len(n), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[~is_end], token[is_end] = words, END
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[np.concatenate(([0], ends[:-1] + 1))] = BOS
    return token, history, np.repeat(np.arange(len(n), dtype=np.int32), n + 1)


def _read(docs: DataFrame, held_out) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").alias("text"))


def _training_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Training texts of about CHUNK tokens together."""
    held, size = [], 0
    for batch in batches:
        for _, held_out, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not held_out:
                held.append(text)
                size += len(text or "") // 5 + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def hot_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(words, exact training counts) of at most HOT frequent words, sorted by word; training tokens; training documents."""

    def frequent(batches):
        for texts in _training_slices(batches):
            token = tokens(texts)[0]
            word, count = np.unique(token, return_counts=True)
            big = count * HOT >= len(token)
            # Rows with no word: all tokens and documents.
            yield pa.RecordBatch.from_arrays([pa.array([None, *word[big].view(np.int64)], pa.int64()), pa.array([len(token), *count[big]], pa.int64()), pa.array([len(texts), *[0] * int(big.sum())], pa.int64())], names=["word", "n", "docs"])
        trim()

    found = rows.mapInArrow(frequent, "word bigint, n bigint, docs bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    got = found.orderBy(F.col("word").isNull().desc(), F.col("n").desc(), "word").limit(HOT + 1).collect()
    total = next(((r["n"] or 0, r["docs"] or 0) for r in got if r["word"] is None), (0, 0))
    words = np.sort(np.array([r["word"] for r in got if r["word"] is not None], np.int64).view(np.uint64))

    def exact(batches):
        count = np.zeros(len(words), np.int64)
        for texts in _training_slices(batches):
            slot, found = _in(words, tokens(texts)[0])
            count += np.bincount(slot[found], minlength=len(words))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], names=["i", "n"])
        trim()

    counts = np.zeros(len(words), np.int64)
    if len(words):
        for r in rows.mapInArrow(exact, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # HOT rows at most
            counts[r["i"]] = r["n"]
    return words, counts, *total


def _bucket(token: np.ndarray, history: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By word; of a hot word by bigram."""
    where = mix(token, 10)
    _, is_hot = _in(hot, token)
    where[is_hot] = mix(token[is_hot] ^ mix(history[is_hot], 9), 10)
    return (where % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)


def _pair(token: np.ndarray, history: np.ndarray) -> np.ndarray:
    return mix(token ^ mix(history, 9), 12)


def _by(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in order) of the buckets that have some."""
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
    ends = np.cumsum(sizes)
    for b in np.flatnonzero(sizes).tolist():
        yield b, order[ends[b] - sizes[b] : ends[b]]


def _grouped(hot: np.ndarray, word: np.ndarray) -> tuple:
    """Sorted words as columns: each once, and how often."""
    starts = _runs(word)
    return *_named(hot, word[starts]), _small(_lengths(starts, len(word)))


def _counted(hot: np.ndarray, buckets: int):
    """documents -> bigram counts of CHUNK training tokens each, by bucket."""

    def rows(batches):
        for texts in _training_slices(batches):
            token, history, _ = tokens(texts)
            order = np.lexsort((history, token))
            token, history = token[order], history[order]
            starts = _runs(token, history)
            n = _lengths(starts, len(token))
            token, history = token[starts], history[starts]
            for b, at in _by(_bucket(token, history, hot, buckets), buckets):
                yield _pack("n", b, *_grouped(hot, token[at]), *_named(hot, history[at]), _small(n[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches))
        trim()

    return run


def _bigrams(hot: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, history, count) of a row of kind n."""
    return np.repeat(_words(hot, *columns[:3]), columns[3]), _words(hot, *columns[4:7]), columns[7]


def _merged(hot: np.ndarray, hot_counts: np.ndarray, buckets: int):
    """Counts of a bucket -> its bigrams ('n') and words ('u'), its histories' masses ('h', by history), statistics ('s')."""

    def one(bucket: int, values: list[tuple]) -> Iterator[tuple]:
        parts = []
        while values:
            _, size, blob = values.pop()
            parts.append(_bigrams(hot, _unpack(size, blob)))
        word, history, n = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((history, word))
        word, history, n = word[order], history[order], n[order].astype(np.int64)
        starts = _runs(word, history)
        word, history, n = word[starts], history[starts], np.add.reduceat(n, starts)
        yield _pack("n", bucket, *_grouped(hot, word), *_named(hot, history), _small(n))
        starts = _runs(word)
        total = np.add.reduceat(n, starts)
        slot, is_hot = _in(hot, word[starts])
        yield _pack("u", bucket, word[starts][~is_hot], _small(total[~is_hot]))
        yield _pack("s", 0, np.array([int((~is_hot).sum())]), np.bincount(np.minimum(n, CUT + 2), minlength=CUT + 3))
        total[is_hot] = hot_counts[slot[is_hot]]
        mass = np.repeat(total + 1, _lengths(starts, len(word)))
        order = np.argsort(history, kind="stable")
        history, n, mass = history[order], n[order], mass[order]
        starts = _runs(history)
        columns = [np.add.reduceat(mass, starts), *(np.add.reduceat((n == r).astype(np.int64), starts) for r in range(1, CUT + 1)), np.add.reduceat((n > CUT).astype(np.int64), starts)]
        history = history[starts]
        where = (mix(history, 11) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        for b, at in _by(where, buckets):
            yield _pack("h", b, *_named(hot, history[at]), *(_small(c[at]) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, values in _groups(batches):
            yield from _batched(one(bucket, values))
            trim()

    return run


def discounts(n_r: np.ndarray) -> np.ndarray:
    """Good-Turing: the discounted value of counts 1 to CUT (index 0 unused). n_r: bigrams by count; where an estimate is of no use the count loses a half."""
    out = np.arange(CUT + 1, dtype=np.float64)
    top = (CUT + 1) * n_r[CUT + 1] / n_r[1] if n_r[1] else 1.0
    for r in range(1, CUT + 1):
        raw = (r + 1) * n_r[r + 1] / n_r[r] if n_r[r] else 0.0
        made = (raw - r * top) / (1 - top) if top < 1 else 0.0
        out[r] = made if 0 < made < r else r - 0.5
    return out


def _with_start(hot: np.ndarray) -> np.ndarray:
    return np.sort(np.append(hot, BOS))


def _weighed(hot: np.ndarray, n: int, v: int, star: np.ndarray):
    """Masses of a history bucket -> log10 of alpha(h) * c(h): 'w' of the rare histories, 'hot' of the others."""
    known = _with_start(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, values in _groups(batches):
            got = [_unpack(size, blob) for _, size, blob in values]
            history = np.concatenate([_words(hot, *g[:3]) for g in got])
            order = np.argsort(history, kind="stable")
            starts = _runs(history[order])
            summed = [np.add.reduceat(np.concatenate([g[k] for g in got]).astype(np.int64)[order], starts) for k in range(3, CUT + 5)]
            history = history[order][starts]
            freed = sum(((r - star[r]) * summed[r] for r in range(1, CUT + 1)), TAIL * summed[CUT + 1])
            weight = np.log10(freed) - np.log10(1 - summed[0] / (n + v + 1))
            slot, is_hot = _in(known, history)
            yield _batch([_pack("w", bucket, history[~is_hot], weight[~is_hot]), *([_pack("hot", 0, slot[is_hot], weight[is_hot])] if is_hot.any() else [])])

    return run


class Katz:
    """A fitted model: the tables below path, and the small ones in memory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        self.n, self.v, self.train_docs, self.buckets, self.star = meta["n"], meta["v"], meta["train_docs"], meta["buckets"], np.array(meta["star"])
        got = spark.read.parquet(f"{path}/hot").collect()  # HOT + 1 rows at most
        word = np.array([r["word"] for r in got], np.int64).view(np.uint64)
        order = np.argsort(word)
        known, counts, weights = word[order], np.array([r["n"] for r in got], np.int64)[order], np.array([r["weight"] for r in got], np.float64)[order]
        plain = known != BOS
        self.hot, self.hot_counts, self.hot_weights = known[plain], counts[plain], weights

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(f"{self.path}/{name}")

    def bigrams(self) -> DataFrame:
        """word, history, n of the counts table, words as their hashes."""
        hot = self.hot

        def run(batches):
            for _, _, size, blob in _rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64)) for c in _bigrams(hot, _unpack(size, blob))], names=["word", "history", "n"])

        return self._table("counts").where("kind = 'n'").mapInArrow(run, "word bigint, history bigint, n bigint")

    def score(self, docs: DataFrame, held_out) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; held_out: a condition, for the column only."""
        bound_batches(self.spark)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(self.buckets, 4096))
        dealt = lambda df: df.repartition(parts, "key").sortWithinPartitions("key", "kind")
        met = _read(docs, held_out).mapInArrow(_tokens_dealt(self.hot, self.buckets), _ROW).unionByName(self._table("counts").where("kind IN ('n', 'u')"))
        with shuffles_end(self.spark):
            found = cut(dealt(met).mapInArrow(_looked_up(self), _ROW), "katz-parts")
        release(self.spark)
        asked = found.where("kind = 'x'").unionByName(self._table("weights").where("kind = 'w'"))
        answers = dealt(asked).mapInArrow(_answered, _ROW)
        return dealt(found.where("kind IN ('d', 'head')").unionByName(answers)).mapInArrow(_added_up(self.n, self.v, self.train_docs), _OUT)


def fit(docs: DataFrame, held_out, path: str | None = None) -> Katz:
    """Train on the rows for which the condition held_out is not true and write the model's tables below path."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or fresh_path(spark, "katz")
    rows = _read(docs, held_out)
    hot, hot_counts, n, train_docs = hot_words(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-n // PER_BUCKET))
    dealt = lambda df: df.repartition(max(parts, min(buckets, 4096)), "key").sortWithinPartitions("key")
    with shuffles_end(spark):
        made = cut(dealt(rows.mapInArrow(_counted(hot, buckets), _ROW)).mapInArrow(_merged(hot, hot_counts, buckets), _ROW), "katz-merged")
    release(spark)
    v, n_r = int((hot_counts > 0).sum()), np.zeros(CUT + 3, np.int64)
    for r in made.where("kind = 's'").select("size", "columns").toLocalIterator():  # one small row a bucket
        words, by_count = _unpack(r["size"], bytes(r["columns"]))
        v, n_r = v + int(words[0]), n_r + by_count
    star = discounts(n_r)
    made.where("kind IN ('n', 'u')").write.parquet(f"{path}/counts")
    with shuffles_end(spark):
        dealt(made.where("kind = 'h'")).mapInArrow(_weighed(hot, n, v, star), _ROW).write.parquet(f"{path}/weights")
    drop_table(made)
    weights = np.zeros(len(hot) + 1)
    for r in spark.read.schema(_ROW).parquet(f"{path}/weights").where("kind = 'hot'").select("size", "columns").toLocalIterator():  # HOT + 1 numbers in all
        slot, weight = _unpack(r["size"], bytes(r["columns"]))
        weights[slot] = weight
    known = _with_start(hot)
    counts = np.zeros(len(known), np.int64)
    counts[known != BOS] = hot_counts
    counts[known == BOS] = train_docs
    spark.createDataFrame(list(zip(known.view(np.int64).tolist(), counts.tolist(), weights.tolist())), "word bigint, n bigint, weight double").coalesce(1).write.parquet(f"{path}/hot")
    meta = {"n": n, "v": v, "train_docs": train_docs, "buckets": buckets, "star": star.tolist()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
    release(spark)
    return Katz(spark, path)


def _tokens_dealt(hot: np.ndarray, buckets: int):
    """documents -> their tokens, counted by bigram and document, by bucket ('x'); a row for each chunk of documents ('head')."""

    def rows(batches):
        part, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def chunk() -> Iterator[tuple]:
            nonlocal serial
            ids, out, texts = (list(x) for x in zip(*held))
            held.clear()
            number = part << 20 | serial
            serial += 1
            token, history, doc = tokens(texts)
            n = len(texts)
            del texts
            length = np.bincount(doc, minlength=n)
            known = np.array([i is not None for i in ids], bool)
            yield _pack("head", number % buckets, np.array([number]), np.packbits(known), np.array([i or 0 for i in ids], np.int64), np.packbits(np.array(out, bool)), _small(length))
            order = np.lexsort((history, doc, token))
            token, history, doc = token[order], history[order], doc[order]
            starts = _runs(token, history, doc)
            times = _lengths(starts, len(token))
            token, history, doc = token[starts], history[starts], doc[starts]
            for b, at in _by(_bucket(token, history, hot, buckets), buckets):
                # Within a word the documents ascend, so their steps are small.
                yield _pack("x", b, np.array([number]), *_grouped(hot, token[at]), *_named(hot, history[at]), np.diff(doc[at], prepend=0).astype(np.int32), _small(times[at]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2] or "") // 5 + 1
                if size >= CHUNK or len(held) >> (_LOCAL - 1):
                    yield from chunk()
                    size = 0
        if held:
            yield from chunk()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches))
        trim()

    return run


def _log10(c: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(c, 1).astype(np.float64))


def _looked_up(model: Katz):
    """A bucket's counts and then its tokens -> parts of their documents' scores ('d', by chunk) and what backs off from rare histories ('x', by history)."""
    hot, hot_counts, hot_weights, buckets = model.hot, model.hot_counts, model.hot_weights, model.buckets
    floor = float(np.log10(model.n + model.v + 1))
    logs = np.log10(model.star[1:])
    known = _with_start(hot)
    nothing = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def meet(columns: list[np.ndarray], pairs: tuple, words: tuple) -> Iterator[tuple]:
        number = int(columns[0][0])
        token, history = np.repeat(_words(hot, *columns[1:4]), columns[4]), _words(hot, *columns[5:8])
        doc, times = np.cumsum(columns[8].astype(np.int64)), columns[9].astype(np.float64)
        slot, found = _in(pairs[0], _pair(token, history))
        c_pair = np.where(found, pairs[1][slot], 0) if len(pairs[0]) else np.zeros(len(token), np.int64)
        slot, is_hot = _in(hot, token)
        c_word = np.zeros(len(token), np.int64)
        c_word[is_hot] = hot_counts[slot[is_hot]]
        slot, rare = _in(words[0], token)
        c_word[rare] = words[1][slot[rare]]
        base = _log10(c_word + 1) - floor
        unseen, small = c_pair == 0, (c_pair > 0) & (c_pair <= CUT)
        score = np.where(unseen, base, np.log10(np.maximum(c_pair - TAIL, 0.5)))
        score[small] = logs[c_pair[small] - 1]
        # What a word's own tokens weigh as a history is taken off here, once for the token that follows.
        score -= np.where((token != END) & (c_word > 0), _log10(c_word), 0.0)
        at = np.flatnonzero(unseen)
        slot, is_hot = _in(known, history[at])
        score[at[is_hot]] += hot_weights[slot[is_hot]]
        docs, inverse = np.unique(doc, return_inverse=True)
        total = lambda x: np.bincount(inverse, x * times, len(docs))
        yield _pack("d", number, _small(docs), total(base), total(score), _small(total(c_word > 0).astype(np.int64)))
        at = at[~is_hot]
        where = (mix(history[at], 11) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        for b, i in _by(where, buckets):
            yield _pack("x", b, np.array([number]), history[at][i], _small(doc[at][i]), _small(columns[9][at][i]))

    def rows(batches):
        now, pairs, words = None, nothing, nothing
        for kind, key, size, blob in _rows(batches):
            if key != now:
                now, pairs, words = key, nothing, nothing
            columns = _unpack(size, blob)
            if kind == "n":
                word, history, n = _bigrams(hot, columns)
                pair = _pair(word, history)
                order = np.argsort(pair)
                pairs = pair[order], n[order].astype(np.int64)
                del word, history, n, pair, order
            elif kind == "u":
                words = columns[0], columns[1].astype(np.int64)
            elif kind == "head":
                yield _pack("head", int(columns[0][0]), *columns)
            else:
                yield from meet(columns, pairs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches))
        trim()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A history bucket's weights and then what backs off from them -> sums by document ('a', by chunk)."""

    def rows():
        now, known = None, None
        for kind, key, size, blob in _rows(batches):
            if key != now:
                now, known = key, None
            columns = _unpack(size, blob)
            if kind == "w":
                known = columns
            elif known is not None:
                slot, found = _in(known[0], columns[1])
                weight = np.where(found, known[1][slot], 0.0) if len(known[0]) else np.zeros(len(slot))
                docs, inverse = np.unique(columns[2], return_inverse=True)
                yield _pack("a", int(columns[0][0]), docs, np.bincount(inverse, weight * columns[3], len(docs)))

    yield from _batched(rows())


_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _added_up(n: int, v: int, train_docs: int):
    """Parts of a chunk's documents -> their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in _groups(batches):
            head = next(_unpack(size, blob) for kind, size, blob in values if kind == "head")
            _, known_id, ids, held, length = head
            d = len(ids)
            base, score, known = np.zeros(d), np.zeros(d), np.zeros(d, np.int64)
            for kind, size, blob in values:
                if kind == "head":
                    continue
                columns = _unpack(size, blob)
                docs = columns[0]
                if kind == "a":
                    score[docs] += columns[1]
                else:
                    base[docs] += columns[1]
                    score[docs] += columns[2]
                    known[docs] += columns[3]
            if train_docs:  # the start's own count, as the first token's history
                score -= np.log10(train_docs)
            names = np.unpackbits(known_id, count=d).astype(bool)
            columns = [pa.array(ids, pa.int64(), mask=~names), pa.array(np.unpackbits(held, count=d).astype(bool)), pa.array(length.astype(np.int64)), pa.array(known), pa.array(np.full(d, n, np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _OUT.split(", ")])

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """Every row scored by a model of those for which the condition held_out is not true."""
    return fit(docs, held_out).score(docs, held_out)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), bucket_of("doc_id", 7) == 2)
