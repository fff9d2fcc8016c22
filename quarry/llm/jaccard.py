"""Exact Jaccard self-join of documents on word shingles, and its link components.

A document is the set of its distinct shingles of SHINGLE words (A-Z lower-cased). Documents with equal sets are one
node. Two sets with 100 * |A & B| >= PERCENT * |A | B| differ in at most H elements, H following from their sizes; so
when the hash space is cut into more than H ranges, they agree wholly in some, and in one of the fullest. Nodes that
agree in a range are brought together through the least node of that range (a star, never all pairs), which gives
candidate clusters that no link leaves. The ranges' keys travel once: a task first joins the equal keys of its own
documents, so that a key which many documents have sends one row a task, and what meets at a key is a sorted stream.

Texts that share a phrase by chance agree in a range now and then, and beyond some number of documents such pairs chain
a part of the whole table into one cluster. So a cluster beyond a cell is taken apart once more. Of all R ranges linked
sets agree in R - H at least. Its nodes name all that are not empty; a key of at most COMMON nodes gives its pairs, and a
pair stays that shares as many of these keys as either node's R - H leaves after its empty ranges and commoner keys.
Nodes for which that is nothing (members of large groups, mostly) are joined by stars as before, among themselves.

Within a cluster the count vectors do the work: shingles are hashed into GROUPS groups, and a set is the point of its
group counts. An R-tree over the points bounds the overlap with everything below a tree node by the summed minima of
the query's coordinates and the node's upper corner; what reaches the required overlap at the leaves is verified on the
sets. A cluster beyond a cell's nodes or bytes is dealt into cells, and each pair of cells is a task of its own. It gives
the number of links of each node, weighted by documents, and of the links only those that span its components, which join
into components in Spark: a group's links grow with its square, what is written does not.

Defined cases: n_links counts the other documents (doc_ids) that a document is linked with, equal sets included;
without words the set is empty, n_shingles 0, linked with nothing and its own component; one or two
words are one shingle; a null doc_id is never linked and its component is null; rows repeating a doc_id should repeat
its text (each row gets its own set's component); an empty table gives an empty table; a text of any length is read
whole, its hashes (8 bytes a word) in one task. Extra columns are not read. Hashes have 64 bits: of n different words or
shingles some two are taken for one with a chance of n * n / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, cut, drop_table, mix, perhaps, release, shuffles_end, text_batches, trim, without, word_hashes
from quarry.llm.graph import components

SHINGLE, PERCENT = 3, 90
GROUPS = 64
#: Nodes of one cell of a large cluster, and bytes of their sets; a task holds two cells.
CELL, CELL_BYTES = 512, 16_000_000
LEAF = 32
#: Nodes of a key that gives all its pairs when a large cluster is taken apart.
COMMON = 8
#: Keys that a task gathers before it joins equal ones.
GATHER = 1_000_000


_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = mix(h, 1)
        full = rolled[: max(0, len(h) - k + 1)].copy()
        for j in range(1, k):
            full = mix(full * _STEP + rolled[j : j + len(full)], 2)
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            one = rolled[a : a + 1]
            with np.errstate(over="ignore"):
                for j in range(1, b - a):
                    one = mix(one * _STEP + rolled[a + j : a + j + 1], 2)
            yield mix(one, 90 + b - a)
        else:
            yield np.empty(0, np.uint64)


def band_bounds(top: int) -> list[int]:
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


_BOUNDS = np.array(band_bounds(1 << 40))


def node_of(s: np.ndarray) -> int:
    """The name of a set: a hash of its elements, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = np.array([mix(s, 4).sum(dtype=np.uint64) + np.uint64(len(s))])
    return int(mix(total, 5).view(np.int64)[0])


def most_apart(n: int, m: int, percent: int) -> int:
    """The greatest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (n + m) // (100 + percent)


def _banded(s: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(band, most ranges in which linked sets differ, keys of all ranges, their sizes) for the set's size band and, near its upper edge, the next band too."""
    n = len(s)
    band = int(np.searchsorted(_BOUNDS, n, side="right")) - 1
    apart = most_apart(n, 100 * n // percent, percent)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s, 6), dtype=np.uint64)))
        for b in (band, band + 1):
            if b > band and 100 * n < percent * int(_BOUNDS[b]):
                break
            top = int(_BOUNDS[b + 1]) - 1
            ranges = most_apart(top, 100 * top // percent, percent) + 1
            ranges += max(1, ranges // 4) if ranges > 1 else 0
            part = ((s >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            size = edges[1:] - edges[:-1]
            content = (sums[edges[1:]] - sums[edges[:-1]]) + size.astype(np.uint64)
            yield b, apart, mix(mix(content, 7) ^ (np.arange(ranges, dtype=np.uint64) + np.uint64(b << 40)), 8), size


def _fullest(apart: int, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    return keys[np.argsort(-size, kind="stable")[: apart + 1]]


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of ranges of the hash space, for the set's size band and, near its upper edge, the next band too.

    A band has more ranges than its largest sets can differ in. Linked sets of which one has this size differ in at
    most `apart` ranges, so they agree in at least ranges - apart; the fullest of those is, in either set, among the
    apart + 1 fullest ranges. Only these are named: near-empty ranges, which unrelated sets share, are left out.
    """
    return np.concatenate([_fullest(*x) for _, *x in _banded(s, percent)]).view(np.int64)


def nodes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, node (null if empty) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_batches(batch, "text"):
                found = [(len(s), node_of(s) if len(s) else None) for s in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["doc_id", "n_shingles", "node"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint")


def _starred(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the runs of equal keys, a, b) of rows sorted by key and node: a is a run's least node, b each other of it; every pair once."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    a = np.repeat(node[starts], np.diff(np.append(starts, len(key))))
    apart = a != node
    if not apart.any():
        return starts, a[:0], a[:0]
    a, b = np.unique(np.stack([a[apart], node[apart]]), axis=1)
    return starts, a, b


_DEALT = "key bigint, node bigint, other bigint"


def _dealt(key: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows to be dealt by key: (key, node, null), and finished pairs (any key, a, b)."""
    other = pa.concat_arrays([pa.nulls(len(key), pa.int64()), pa.array(b, pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((key, b))), pa.array(np.concatenate((node, a))), other], names=["key", "node", "other"])


def keyed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, node, other of the documents' ranges, equal keys of one task joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        names: list[np.ndarray] = []
        size = 0

        def done() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(names)
            keys.clear()
            names.clear()
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            starts, a, b = _starred(key, node)
            return _dealt(key[starts], node[starts], a, b)

        for batch in batches:
            for _, texts in text_batches(batch, "text"):
                for s in shingle_sets(texts, k):
                    if len(s):
                        keys.append(keys_of(s, percent))
                        names.append(np.full(len(keys[-1]), node_of(s)))
                        size += len(keys[-1])
                    if size >= GATHER:
                        yield done()
                        size = 0
        if size:
            yield done()
        trim()

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, _DEALT)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keyed(), sorted by key and node -> the pairs (a, b)."""
    last = None  # key and least node of the run that may go on
    for batch in batches:
        key, node = (np.asarray(batch.column(i)) for i in (0, 1))
        made = batch.column(2).is_valid()
        plain = ~np.asarray(made.to_numpy(zero_copy_only=False), bool)
        key, node, ready = key[plain], node[plain], batch.filter(made)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(key):
            if last is not None and last[0] == key[0]:
                key, node = np.append(last[0], key), np.append(last[1], node)
            starts, a, b = _starred(key, node)
            last = key[-1], node[starts[-1]]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([ready.column(1), pa.array(a)]), pa.concat_arrays([ready.column(2), pa.array(b)])], names=["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, band, need), sorted by key, node and band -> of keys that at most COMMON nodes have their pairs, as (a, b, band, number of keys), of commoner ones (node, null, band, -1), and rows with a need as (node, null, band, need)."""
    held = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)]  # the last key's rows while they are few
    common = None  # the last key once they are not

    def found(key: np.ndarray, node: np.ndarray, band: np.ndarray, every: np.ndarray) -> pa.RecordBatch:
        """every: of each row the rows that its key has."""
        many = every > COMMON
        a, b, of = ([np.empty(0, t)] for t in (np.int64, np.int64, np.int32))
        for d in range(1, COMMON):
            at = np.flatnonzero((key[:-d] == key[d:]) & ~many[d:])
            a.append(node[at])
            b.append(node[at + d])
            of.append(band[at])
        a, b, of = map(np.concatenate, (a, b, of))
        order = np.lexsort((of, b, a))
        a, b, of = a[order], b[order], of[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(a)))
        b = pa.concat_arrays([pa.array(b[starts], pa.int64()), pa.nulls(int(many.sum()), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[starts], node[many]))), b, pa.array(np.concatenate((of[starts], band[many]))), pa.array(np.concatenate((n, np.full(many.sum(), -1))).astype(np.int32))], names=["a", "b", "band", "n"])

    last = None  # a repeated doc_id repeats its rows, which are next to each other
    for batch in batches:
        if not len(batch):
            continue
        once = np.ones(len(batch), bool)
        columns = [np.asarray(batch.column(i)) for i in range(3)]
        once[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        once[0] = last != tuple(int(c[0]) for c in columns)
        last = tuple(int(c[-1]) for c in columns)
        batch = batch.filter(pa.array(once))
        made = batch.column(3).is_valid()
        ready = batch.filter(made)
        yield pa.RecordBatch.from_arrays([ready.column(1), pa.nulls(len(ready), pa.int64()), ready.column(2), ready.column(3)], names=["a", "b", "band", "n"])
        plain = ~np.asarray(made.to_numpy(zero_copy_only=False), bool)
        rows = [np.concatenate((h, np.asarray(batch.column(i))[plain])) for i, h in enumerate(held)]
        if not len(rows[0]):
            continue
        key = rows[0]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(key)))
        count[0] += (COMMON + 1) * (common == int(key[0]))
        common = int(key[-1]) if count[-1] > COMMON else None
        end = len(key) if common is not None else int(starts[-1])
        yield found(*(c[:end] for c in rows), np.repeat(count, np.diff(np.append(starts, len(key))))[:end])
        held = [c[end:] for c in rows]
    if len(held[0]):
        yield found(*held, np.full(len(held[0]), len(held[0])))


def _apart(large: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The stars (a, b) of the nodes of large clusters (node, doc_id, cluster) that still may be linked."""

    def named(all_ranges: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: list[tuple] = []
                sets = (s for _, texts in text_batches(batch, "text") for s in shingle_sets(texts, k))
                for c, node, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets):
                    for band, apart, keys, size in _banded(s, percent) if len(s) and node_of(s) == node else ():
                        use = keys[size > 0] if all_ranges else _fullest(apart, keys, size)
                        use = mix(use ^ np.uint64(c & 0xFFFFFFFFFFFFFFFF), 9).view(np.int64)
                        held.append((use, node, band, None))
                        if all_ranges:
                            held.append((np.array([node]), node, band, int((size > 0).sum()) - apart))
                if held:
                    n = [len(x[0]) for x in held]
                    need = pa.array([x[3] for x in held], pa.int32()).take(pa.array(np.repeat(np.arange(len(held)), n)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in held])), pa.array(np.repeat(np.array([x[1] for x in held], np.int64), n)), pa.array(np.repeat(np.array([x[2] for x in held], np.int32), n)), need], names=["key", "node", "band", "need"])
            trim()

        return run

    def rows(ids: DataFrame, all_ranges: bool) -> DataFrame:
        some, _ = perhaps(docs.select("doc_id", "text"), ids.select("doc_id"), "doc_id")
        texts = some.hint("merge").join(ids, "doc_id").select("text", "cluster", "node")
        return texts.mapInArrow(named(all_ranges), "key bigint, node bigint, band int, need int")

    met = cut(rows(large, True).repartition("key").sortWithinPartitions("key", "node", "band").mapInArrow(_pairs, "a bigint, b bigint, band int, n int"), "jaccard-met")
    need = cut(met.where("b IS NULL").groupBy(F.col("a").alias("node"), "band").agg(F.sum("n").alias("need")), "jaccard-need")
    pairs = met.where("b IS NOT NULL").groupBy("a", "b", "band").agg(F.sum("n").alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(need.select(F.col("node").alias(side), "band", F.col("need").alias(f"need_{side}")), [side, "band"])
    few = need.where("need <= 0").select("node", "band")
    again = rows(large.join(few.select("node").distinct(), "node", "left_semi"), False).join(few, ["node", "band"], "left_semi")
    starred = again.select("key", "node", F.lit(None).cast("long").alias("other")).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a bigint, b bigint")
    out = cut(pairs.where("n >= need_a AND n >= need_b").select("a", "b").unionByName(starred), "jaccard-apart")
    for done in (met, need):
        drop_table(done)
    return out


class RTree:
    """Bulk-loaded over count vectors: levels of boxes, of which only upper corners and size ranges are needed."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:  # halve along the widest coordinate until a leaf holds what is left
            part = todo.pop()
            if len(part) <= LEAF:
                order.append(part)
                continue
            wide = int((points[part].max(0) - points[part].min(0)).argmax())
            part = part[np.argsort(points[part, wide], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.order = np.concatenate(order)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in order])))
        self.points, self.sizes = points[self.order], sizes[self.order]
        # levels[0] are the leaves: upper corner, least and greatest size, first and last child.
        upper = np.maximum.reduceat(self.points, starts[:-1])
        small, large = np.minimum.reduceat(self.sizes, starts[:-1]), np.maximum.reduceat(self.sizes, starts[:-1])
        self.levels = [(upper, small, large, starts)]
        while len(upper) > 1:
            cuts = np.arange(0, len(upper), 8)
            upper, small, large = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            self.levels.append((upper, small, large, np.append(cuts, len(self.levels[-1][0]))))

    def query(self, q: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of the pairs whose summed minima reach the overlap that their sizes require."""
        upper = self.levels[-1][0]
        who, at = np.repeat(np.arange(len(q)), len(upper)), np.tile(np.arange(len(upper)), len(q))
        for upper, small, large, starts in reversed(self.levels):
            fit = (100 * large[at] >= percent * n[who]) & (100 * n[who] >= percent * small[at])
            who, at = who[fit], at[fit]
            bound = np.minimum(q[who], upper[at]).sum(1, dtype=np.int64)
            fit = (100 + percent) * bound >= percent * (n[who] + np.maximum(small[at], -(-percent * n[who] // 100)))
            who, at = who[fit], at[fit]
            count = starts[at + 1] - starts[at]
            first = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(count)))[:-1], count)
            who, at = np.repeat(who, count), first + np.arange(count.sum())
        bound = np.minimum(q[who], self.points[at]).sum(1, dtype=np.int64)
        fit = (100 + percent) * bound >= percent * (n[who] + self.sizes[at])
        return who[fit], self.order[at[fit]], bound[fit]


def link(sets: list[np.ndarray], other: list[np.ndarray] | None, percent: int, docs: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components within sets, or between sets and other (whose numbers follow on), and of each set the documents of all sets it is linked with (docs: of each)."""
    every = sets + (other or [])
    n = np.array([len(s) for s in every], np.int64)
    points = np.stack([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in every]).astype(np.int32)
    inside = range(len(sets)) if other is None else range(len(sets), len(every))
    tree = RTree(points[inside.start : inside.stop], n[inside.start : inside.stop])
    names, ids = np.unique(np.concatenate(every), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)))
    marked = np.zeros(len(names), np.int32)
    parent = list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, links = [], np.zeros(len(every), np.int64)
    for at in range(0, len(sets), 128):
        q = np.arange(at, min(at + 128, len(sets)))
        who, point, _ = tree.query(points[q], n[q], percent)
        a, b = q[who], point + inside.start
        if other is None:
            a, b = a[a < b], b[a < b]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edges = np.searchsorted(a, np.arange(q[0], q[-1] + 2))
        for x, lo, hi in zip(q.tolist(), edges.tolist(), edges[1:].tolist()):
            if lo == hi:
                continue
            ys = b[lo:hi]
            mine = ids[starts[x] : starts[x + 1]]
            marked[mine] = 1
            ends = np.cumsum(n[ys])
            spots = np.arange(ends[-1]) + np.repeat(starts[ys] - (ends - n[ys]), n[ys])
            common = np.add.reduceat(marked[ids[spots]], ends - n[ys])
            marked[mine] = 0
            ys = ys[100 * common.astype(np.int64) >= percent * (n[x] + n[ys] - common)]
            links[x] += docs[ys].sum()
            links[ys] += docs[x]
            for y in ys.tolist():
                rx, ry = find(x), find(y)
                if rx != ry:
                    parent[ry] = rx
                    out.append((x, y))
    return out, links


def _linker(percent: int):
    """Rows (cluster, i, j, side, node, docs, set), sorted: of each cell pair the spanning links, as (a, b, null), and the numbers of links, as (a, null, n_links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, docs = None, ({}, {}), ({}, {})

        def done() -> pa.RecordBatch:
            first, second = cells
            names = [*first, *second]
            spans, links = [], np.zeros(0, np.int64)
            if first and (second or now[1] == now[2]):
                spans, links = link(list(first.values()), list(second.values()) or None, percent, np.array([*docs[0].values(), *docs[1].values()], np.int64))
            some = np.flatnonzero(links).tolist()
            for held in (*cells, *docs):
                held.clear()
            a = [names[x] for x, _ in spans] + [names[x] for x in some]
            b = [names[y] for _, y in spans] + [None] * len(some)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(spans) + links[some].tolist(), pa.int64())], names=["a", "b", "n_links"])

        for batch in batches:
            for *key, side, node, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if now is not None:
                        yield done()
                    now = key
                cells[side][node] = np.frombuffer(raw, np.uint64)
                docs[side][node] = n
        if now is not None:
            yield done()

    return run


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row."""
    with shuffles_end(docs.sparkSession):
        return _join(docs, k, percent)[0]


def _join(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(join(), the tables that it is read from)."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    table = cut(nodes(docs, k), "jaccard-nodes")
    named = table.where("doc_id IS NOT NULL AND node IS NOT NULL")
    stars = cut(keyed(docs, k, percent).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a bigint, b bigint"), "jaccard-stars")
    release(spark)
    found = components(stars)
    clusters = cut(found.withColumnRenamed("root", "cluster"), "jaccard-clusters")
    least = cut(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count_distinct("doc_id").alias("docs"), F.max("n_shingles").alias("size")), "jaccard-least")
    whole = F.greatest(F.ceil(F.count("*") / F.lit(CELL)), F.ceil(F.sum("size") * 8 / F.lit(CELL_BYTES))).cast("int")

    def sized(clusters: DataFrame) -> DataFrame:
        return cut(clusters.join(least, "node").groupBy("cluster").agg(whole.alias("cells")), "jaccard-sizes")

    # Large clusters may hold together by chance: what they are taken apart to counts instead.
    chained, cells = clusters, sized(clusters)
    placed = chained.join(cells, "cluster")
    large = cut(placed.where("cells > 1").join(least, "node").select("node", "cluster", F.col("least").alias("doc_id")), "jaccard-large")
    apart = _apart(large, docs, k, percent)
    parts = components(apart)
    clusters = cut(placed.where("cells = 1").select("node", "cluster").unionByName(parts.select("node", F.col("root").alias("cluster"))), "jaccard-clusters")
    for done in (chained, cells, large, apart, parts):
        drop_table(done)
    cells = sized(clusters)
    placed = clusters.join(least, "node")
    members = cut(placed.join(cells, "cluster").select("node", "cluster", "cells", "docs", F.col("least").alias("doc_id")), "jaccard-members")
    read, _ = perhaps(docs.select("doc_id", "text"), members.select("doc_id"), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_batches(batch, "text"):
                full = [(i, s) for i, s in enumerate(shingle_sets(texts, k), at) if len(s)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in full], pa.int64())), pa.array([node_of(s) for _, s in full], pa.int64()), pa.array([s.tobytes() for _, s in full], pa.binary())], names=["doc_id", "node", "set"])
        trim()

    placed = members.select("node", "doc_id", "cluster", "cells", "docs", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"))
    # The same join at every size: few members would else be broadcast, and what is shuffled then jump as they grow.
    placed = placed.hint("merge").join(read.mapInArrow(sets, f"doc_id {kind}, node bigint, set binary"), ["node", "doc_id"])
    # A cell meets every cell of its cluster once; a set goes to `cells` tasks, most often to one.
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    met = met.select("cluster", F.least("cell", "with").alias("i"), F.greatest("cell", "with").alias("j"), F.when(F.col("cell") > F.col("with"), 1).otherwise(0).alias("side"), "node", "docs", "set")
    met = met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "node")
    links = cut(met.mapInArrow(_linker(percent), "a bigint, b bigint, n_links bigint"), "jaccard-links")
    release(spark)
    linked = components(links.where("b IS NOT NULL").select("a", "b"))
    numbers = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("others"))
    classes = least.join(linked, "node", "left").join(numbers, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-roots")
    of_node = cut(classes.select("node", "root", (F.coalesce("others", F.lit(0)) + F.col("docs") - 1).alias("n_links")).join(of_root, "root").select("node", "component_id", "n_links"), "jaccard-components")
    for done in (stars, found, clusters, least, cells, members, links, linked, of_root):
        drop_table(done)
    release(spark)
    out = table.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    empty = F.when(F.col("node").isNull(), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", empty)).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links")), [table, of_node]


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of join()."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: Shingle size and least similarity where no contract says otherwise.
DEDUPE_SHINGLE, DEDUPE_PERCENT = 5, 80


def deduplicate(docs: DataFrame, k: int = DEDUPE_SHINGLE, percent: int = DEDUPE_PERCENT) -> DataFrame:
    """The documents without those linked to one of a smaller id: one of each component stays, with all columns as they were."""
    with shuffles_end(docs.sparkSession):
        found, tables = _join(docs, k, percent)
        gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    for table in tables:
        drop_table(table)
    return without(docs, gone, "doc_id")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p WHERE 100 * c >= 90 * (na + nb - c)
), r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.y, s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.x = s.doc_id
"""
