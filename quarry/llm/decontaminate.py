"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Characters (code points of lower-cased text with single spaces) are the symbols. Every run of `seed` characters of an
item, at every offset, is a seed; a document's place is a candidate where it holds one. A passage is missed only if
no run of that many characters of the item is free of edits, so the seed follows from the item (seed_of): the longest for which a passage with as many edits
as the limit allows, at random places, and one with a typo in every word, each hold a seed with a chance of RECALL at
least. Fewer edits raise it, and exact passages are always found.

The method asked for, random-walk (CGK) embeddings of item-sized windows with sampled positions as keys, cannot reach
that recall here: at a similarity of 0.8 two walks agree in 28 to 40 % of their positions, so that samples long enough to
tell passages from other text would need a million repetitions (README, with figures). Hence seeds.

A candidate's surroundings are looked at first: up to SIDE characters of the item on each side of the seed are to be
within FRAME_SHARE edits a character of the text there, by bit-parallel dynamic programming over many candidates at once. Of a passage
within the limit some part has no more than the limit's share of edits; FRAME_SHARE leaves half as much again. Where the
sides reach the whole item it is the limit itself. What remains is verified exactly: the item's edit distance, in
characters, to the nearest stretch of the document around the place. It counts if it is at most (1 - SIMILARITY) of the
item's characters.

Defined cases: null and empty texts and items match nothing; an item so short that the limit is no edit matches as whole
words only; equal items each report; of several places one row per document row and item stays, that of the least
distance and then the first; repeated rows give repeated results; ids may be of any type and null, and are handed on as
they are; without documents or without items nothing is found and everything is clean; texts beyond LONG characters are
searched in pieces that overlap by more than any passage; only doc_id, item_id and the two columns text are read, and
cleaning hands on all columns, whatever they are called. The benchmark is sent to the tasks in blocks of BLOCK_CHARS
characters, one pass over the documents for each; if there are several, each pass is written before the next begins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import bound_batches, cut, text_batches, trim

SIMILARITY = 0.8
#: Lengths of seeds, in characters, and the least chance that a passage at the limit holds one.
SEEDS = tuple(range(1, 11))
RECALL = 0.95
#: Characters of an item that are compared on each side of a seed (half a word of bits, less one), and their most edits a character.
SIDE, FRAME_SHARE = 31, 0.3
#: Least bits of the table that tells at once that some characters are no seed.
SIEVE = 20
#: Stands between texts; no code point.
SEAM = 0x110000
BLOCK_CHARS = 16_000_000
#: Characters of a text that are searched at once (some 60 bytes of memory each).
LONG = 2_000_000
FOUND = "doc_id {kind}, item_id {item}, distance int, item_chars int, first_word bigint, n_words int"


@lru_cache(100_000)
def _missed(chars: int, most: int, q: int) -> float:
    """The chance that `most` edits at random places of so many characters leave no q in a row: all gaps between them are shorter."""
    ways = sum((-1) ** j * math.comb(most + 1, j) * math.comb(chars - j * q, most) for j in range(min(most + 1, (chars - most) // q) + 1))
    return ways / math.comb(chars, most)


@lru_cache(100_000)
def _short(a: int, b: int, q: int) -> float:
    """The chance that fewer than q characters lie between a typo in a word of a letters and one in the next, of b."""
    return 1 - sum(min(b, max(0, b - (q - u))) for u in range(1, a + 1)) / (a * b)


def seed_of(text: str, most: int) -> int:
    """The length of the seeds of an item of which `most` characters may be edited."""
    n, words = len(text), [min(len(w), 64) for w in text.split(" ")]
    for q in reversed(SEEDS):
        # Items of 300 characters have 61 gaps at the limit and more: certain enough.
        if q <= n and (n >= 300 or _missed(n, most, q) <= 1 - RECALL):
            if most == 0 or math.prod(_short(a, b, q) for a, b in zip(words, words[1:])) <= 1 - RECALL or q <= n // (most + 1):
                return q
            if len(words) < 3:  # one or two typos at most: the first chance is the whole of it
                return q
    return 1


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, seams): code points of all texts, A-Z lower-cased and spaces single, and the places of the seams around them."""
    seam = SEAM.to_bytes(4, "little")
    c = np.frombuffer(seam + b"".join((t or "").encode("utf-32-le", "surrogatepass") + seam for t in texts), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    keep = ~space
    keep[1:] |= ~(space | (c == SEAM))[:-1]
    c, space = c[keep], space[keep]
    c = np.where(space, np.uint32(32), c + ((c >= 65) & (c <= 90)).astype(np.uint32) * np.uint32(32))
    return c, np.flatnonzero(c == SEAM)


_STEP = 0x9E3779B97F4A7C15


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` characters from each place on."""
    with np.errstate(over="ignore"):
        out, n = codes.astype(np.uint64), 1
        for bit in bin(size)[3:]:
            out, n = out[: len(out) - n] * np.uint64(pow(_STEP, n, 1 << 64)) + out[n:], 2 * n
            if bit == "1":
                out, n = out[:-1] * np.uint64(_STEP) + codes[n : n + len(out) - 1], n + 1
        return out


_LOW, _HIGH = np.uint64((1 << 32) - 1), np.uint64(((1 << 32) - 1) << 32)
_ROWS, _FIRST = np.uint64((1 << 31) - 1 | ((1 << 31) - 1) << 32), np.uint64(1 | 1 << 32)


def framed(low: np.ndarray, left_of: np.ndarray, right_of: np.ndarray, left: np.ndarray, right: np.ndarray, frame: np.ndarray, text: np.ndarray, at: np.ndarray, till: np.ndarray, columns: int) -> np.ndarray:
    """For each candidate the edits to the left of its seed and to the right of it, added up.

    Frames are left characters of low before left_of and right ones from right_of on (SIDE each at most); candidate i
    compares frame[i] with the text before at[i] and from till[i] on, up to `columns` characters. Characters are told apart by their low seven bits
    only, which can but lessen the distance. One word of bits holds both sides.
    """
    one, half, rows = np.uint64(1), np.uint64(32), np.arange(len(left))
    masks = np.zeros((len(left), 128), np.uint64)
    for j in range(SIDE):
        for side, spot, bit in ((right, right_of + j, j), (left, left_of - 1 - j, 32 + j)):
            used = rows[j < side]
            masks[used, low[spot[used]]] |= np.uint64(1 << bit)
    masks = masks.ravel()
    base, last = frame * 128, len(text) - 1
    scores = [right[frame].copy(), left[frame].copy()]
    tops = [np.maximum(right[frame] - 1, 0).astype(np.uint64), np.maximum(left[frame] - 1, 0).astype(np.uint64) + half]
    best = [x.copy() for x in scores]
    plus, minus = np.full(len(frame), _ROWS), np.zeros(len(frame), np.uint64)
    for j in range(columns):
        eq = (masks[base + text[np.minimum(till + j, last)]] & _LOW) | (masks[base + text[np.maximum(at - 1 - j, 0)]] & _HIGH)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & _ROWS
        mh = plus & xh & _ROWS
        for score, top, least in zip(scores, tops, best):
            score += (ph >> top & one).view(np.int64)
            score -= (mh >> top & one).view(np.int64)
            np.minimum(least, score, out=least)
        ph, mh = ph << one | _FIRST, mh << one
        plus = (mh | ~(xv | ph)) & _ROWS
        minus = ph & xv & _ROWS
    return np.where(right[frame] > 0, best[0], 0) + np.where(left[frame] > 0, best[1], 0)


def nearest(item: str | bytes, text: str | bytes, most: int) -> tuple[int, int] | None:
    """(distance, end): the least edit distance of item to a substring of text, if at most `most`, and its first end."""
    at = text.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    masks: dict[int | str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, j
    return (best, end) if end >= 0 else None


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Items:
    """One block of the benchmark, with its seeds."""

    def __init__(self, rows: list[tuple[object, str | None]], similarity: float = SIMILARITY):
        self.ids = [i for i, _ in rows]
        codes, seams = letters([t for _, t in rows])
        self.text = [_text(codes[a + 1 : b]).rstrip(" ") for a, b in zip(seams, seams[1:])]
        self.begin, self.chars = seams[:-1] + 1, np.array([len(t) for t in self.text], np.int64)
        self.most = np.array([int((1 - similarity) * len(t) + 1e-9) for t in self.text], np.int64)
        self.low = (codes & np.uint32(127)).astype(np.uint8)
        size = np.array([seed_of(t, k) if t else 0 for t, k in zip(self.text, self.most.tolist())], np.int64)
        size[self.most == 0] = np.minimum(self.chars[self.most == 0], SEEDS[-1])
        self.seeds = {}
        for q in sorted({*size.tolist()} - {0}):
            mine = np.flatnonzero(size == q)
            count = self.chars[mine] - q + 1
            item = np.repeat(mine, count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            code = runs(codes, q)[self.begin[item] + offset]
            order = np.argsort(code, kind="stable")
            known, first, count = np.unique(code[order], return_index=True, return_counts=True)
            bits = min(28, max(SIEVE, int(8 * len(known)).bit_length()))
            shift = np.uint64(64 - bits)
            sieve = np.zeros(1 << bits, bool)
            sieve[self._slot(known, shift)] = True
            self.seeds[q] = (sieve, shift, known, first, count, item[order], offset[order])

    @staticmethod
    def _slot(code: np.ndarray, shift: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (code * np.uint64(_STEP) >> shift).view(np.int64)

    def _candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of its first character) of what holds a seed and passes the frame, sorted by both."""
        low = (codes & np.uint32(127)).astype(np.uint8)
        got = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for q, (sieve, shift, known, first, count, items, offsets) in self.seeds.items():
            if len(codes) < q:
                continue
            code = runs(codes, q)
            at = np.flatnonzero(sieve[self._slot(code, shift)])
            i = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            same = known[i] == code[at]
            at, i = at[same], i[same]
            n = count[i]
            post = np.arange(n.sum()) + np.repeat(first[i] - (np.cumsum(n) - n), n)
            item, offset, at = items[post], offsets[post], np.repeat(at, n)
            # Overlapping seeds of one run of equal characters have nearly one frame: the first stands for those in SIDE / 2.
            begin = at - offset
            _, once = np.unique(((begin + int(self.chars.max())) * len(self.ids) + item) * 4096 + offset // (SIDE // 2) % 4096, return_index=True)
            item, offset, at = item[once], offset[once], at[once]
            order = np.lexsort((offset, item))
            for a in range(0, len(order), 2048):
                part = order[a : a + 2048]
                it, of, here = item[part], offset[part], at[part]
                new = np.concatenate(([True], (it[1:] != it[:-1]) | (of[1:] != of[:-1])))
                frame, fi, fo = np.cumsum(new) - 1, it[new], of[new]
                left, right = np.minimum(fo, SIDE), np.minimum(self.chars[fi] - fo - q, SIDE)
                most = np.minimum(self.most[fi], np.where(left + q + right == self.chars[fi], self.most[fi], (FRAME_SHARE * (left + q + right)).astype(np.int64)))
                where = self.begin[fi] + fo
                edits = framed(self.low, where, where + q, left, right, frame, low, here, here + q, int((np.maximum(left, right) + (most + 1) // 2).max()))
                fit = edits <= most[frame]
                got.append((it[fit], here[fit] - of[fit]))
        item, begin = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((begin, item))
        return item[order], begin[order]

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its (item number, distance, first word, words)."""
        long = {i: t for i, t in enumerate(texts) if t and len(t) > LONG}
        found = self._find([None if i in long else t for i, t in enumerate(texts)])
        for i, t in long.items():
            found[i] = self._pieces(t)
        return found

    def _pieces(self, text: str) -> list[tuple[int, int, int, int]]:
        """find() of one long text, in pieces that overlap."""
        overlap = 4 * int(self.chars.max(initial=0)) + 4 * SIDE
        at, words, best = 0, 0, {}
        while True:
            end = at + max(LONG, 4 * overlap)
            for k, distance, first, n in self._find([text[at:end]])[0]:
                best[k] = min(best.get(k, (distance + 1,)), (distance, words + first, n))
            if end >= len(text):
                return [(k, *found) for k, found in sorted(best.items())]
            gap = _GAP.search(text, end - 2 * overlap, end - overlap)
            step = gap.start() if gap else end - overlap
            words += sum(1 for _ in _WORD.finditer(text, at, step)) - (gap is None)
            at = step

    def _find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list] = [[] for _ in texts]
        if not self.seeds:
            return out
        codes, seams = letters(texts)
        item, begin = self._candidates(codes)
        # The place may lie before its document's start, by as many characters as the passage lacks there: the middle does not.
        middle = np.clip(begin + self.chars[item] // 2, 1, len(codes) - 2)
        doc = np.searchsorted(seams, middle, side="right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for d, k, place in zip(doc.tolist(), item.tolist(), begin.tolist()):
            n, most, left, right = len(self.text[k]), int(self.most[k]), int(seams[d]) + 1, int(seams[d + 1])
            wide = max(8, n // 8)
            slot = place // wide if most else place
            if (d, k, slot) in tried or best.get((d, k), (1,))[0] == 0:
                continue
            tried.add((d, k, slot))
            if most:
                a, b = max(left, slot * wide - most), min(right, (slot + 1) * wide + n + most)
            elif {int(codes[place - 1]), int(codes[place + n])} <= {32, SEAM}:
                a, b = place, place + n
            else:
                continue
            stretch = _text(codes[a:b])
            hit = nearest(self.text[k], stretch, most)
            if hit is None:
                continue
            distance, end = hit
            back = nearest(self.text[k][::-1], stretch[:end][::-1], distance)
            start = end - back[1] if back else max(0, end - n)
            found = (distance, int(np.count_nonzero(codes[left : a + start] == 32)), stretch.count(" ", start, end) + 1)
            if (d, k) not in best or found < best[d, k]:
                best[d, k] = found
        for (d, k), (distance, first, n) in sorted(best.items()):
            out[d].append((k, distance, first, n))
        return out


_GAP, _WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark's rows in blocks of a bounded size, and whether more than one block is needed."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_CHARS))
    for block in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        got = [(r[0], r[1]) for r in part.collect()]
        if got:
            yield got, n > 1


def scan(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, item_chars, first_word, n_words of every passage of an item in a document."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = FOUND.format(kind=docs.schema["doc_id"].dataType.simpleString(), item=benchmark.schema["item_id"].dataType.simpleString())
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    names = [f.split()[0] for f in schema.split(", ")]
    out = None
    for rows, several in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, similarity)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                made = []
                for at, texts in text_batches(batch, "text"):
                    for i, hits in enumerate(items.find(texts)):
                        made += [(ids[at + i], items.ids[k], d, len(items.text[k]), first, n) for k, d, first, n in hits]
                cols = list(zip(*made)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column(0).type, item_type, pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names=names)
            trim()

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        if several:
            part = cut(part, "decontaminate-block")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without a passage of any item; all columns as they were."""
    bound_batches(docs.sparkSession)
    at_text = docs.columns.index("text")
    for rows, several in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, similarity)
            for batch in batches:
                keep = [not hits for _, texts in text_batches(batch.select([at_text]), batch.schema.names[at_text]) for hits in items.find(texts)]
                yield batch.filter(pa.array(keep, pa.bool_()))
            trim()

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = cut(docs, "decontaminate-block")
            sent.destroy()
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in the whole documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
