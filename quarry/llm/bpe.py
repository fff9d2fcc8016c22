"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is one token that its encoding ends with. A suffix automaton over the vocabulary
lists the tokens that end at each place; the first whose predecessor (the last token of the shorter prefix) is
compatible with it is that unique last token. Compatibility of a pair is tested by undoing merges from the seam
outwards. Back-pointers give the ids.

Defined cases: a null or empty text has no ids (n_tokens 0, digests of the empty string); texts of any length are
encoded whole; repeated rows give repeated results; an empty table gives an empty table; only the id and the text are
read, so other columns may have any name. The vocabulary's path is a parameter.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, text_batches, trim

#: Distinct words (between white space) whose encoding a worker keeps at most; results do not depend on it.
MEMO = 200_000
#: How many of them, the first met and so mostly the frequent ones, stay then and from one task to the next.
KEPT = 60_000
#: Pairs of tokens whose compatibility a worker keeps.
FITS = 500_000
_END = "</w>"
#: Unicode's White_Space; str.split() also cuts at U+001C to U+001F, which it does not hold.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACES = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class SuffixAutomaton:
    """Of all tokens: while a text is read, the state stands for its longest suffix that occurs in some token."""

    def __init__(self, tokens: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for token in tokens:
            last = 0
            for c in token:
                last = self._extend(last, c)
        for token, i in tokens.items():
            state = 0
            for c in token:
                state = self.next[state][c]
            self.ends[state].append((len(token), i))
        for e in self.ends:
            e.sort(reverse=True)
        # Of each state: the tokens that are suffixes of its longest string, longest first.
        self.out: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.out[s] = (*self.ends[s], *self.out[self.link[s]]) if self.ends[s] else self.out[self.link[s]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        self.ends.append([])
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: str) -> int:
        new = self._state(self.len[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: str) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        new, p = self._state(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new


class Tokenizer:
    """A word-end BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}  # the rank at which two tokens merge
        for rank, (a, b) in enumerate(merges):
            made = vocab.get(a + b)
            if made is not None:
                self.pair.setdefault((vocab[a], vocab[b]), rank)
                if made not in self.rank:
                    self.rank[made], self.parts[made] = rank, (vocab[a], vocab[b])
        self.chars = byte_chars()
        single = {t for t in vocab if len(t.removesuffix(_END)) == 1}
        usable = {t: i for t, i in vocab.items() if i in self.rank or t in single}
        self.automaton = SuffixAutomaton({self._symbols(t): i for t, i in usable.items()})
        self.fits: dict[int, bool] = {}
        letter, number = _classes("L"), _classes("N")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, tuple[str, int, str]] = {}

    @staticmethod
    def _symbols(token: str) -> str:
        """One character a symbol; the one that ends a word stands 0x20000 higher."""
        if token.endswith(_END) and len(token) > len(_END):
            body = token[: -len(_END)]
            return body[:-1] + chr(ord(body[-1]) + 0x20000)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the two tokens' joined text gives just these two: no earlier merge crosses the seam."""
        pair, rank, parts = self.pair, self.rank, self.parts
        limit = 1 << 60  # merges across the seam count only before the two sides are whole
        left_at_seam = True
        while True:
            over = pair.get((a, b))
            if over is not None and (over < limit or over == limit and left_at_seam):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later of the two last merges: at that time the seam had the parts next to it.
            if ra > rb:
                limit, a, left_at_seam = ra, parts[a][1], False
            else:
                limit, b, left_at_seam = rb, parts[b][0], True

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        raw = piece if piece.isalnum() and piece.isascii() else "".join([self.chars[b] for b in piece.encode("utf-8")])
        symbols = raw[:-1] + chr(ord(raw[-1]) + 0x20000)
        follow, link, lens, out, fits = self.automaton.next, self.automaton.link, self.automaton.len, self.automaton.out, self.fits
        last, back = [0], [0]
        state = length = 0
        for end, c in enumerate(symbols, 1):
            while (to := follow[state].get(c)) is None and state:
                state = link[state]
                length = lens[state]
            state, length = (0, 0) if to is None else (to, length + 1)
            for n, token in out[state]:
                if n > length:
                    continue
                before = end - n
                if before:
                    left = last[before]
                    if left < 0:
                        continue
                    key = left << 32 | token
                    fit = fits.get(key)
                    if fit is None:
                        if len(fits) > FITS:
                            fits.clear()
                        fit = fits[key] = self.compatible(left, token)
                    if not fit:
                        continue
                last.append(token)
                back.append(before)
                break
            else:  # only a token can end a word here
                last.append(-1)
                back.append(0)
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def forget(self) -> None:
        """Keep only the words that were met first."""
        for chunk in list(itertools.islice(self.memo, KEPT, None)):
            del self.memo[chunk]

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space, which no pre-token crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased without regard to its place in the word
        text = text.lower()
        return text.split() if _ODD_SPACES.search(text) is None else re.split(f"[{SPACES}]+", text)

    def _entry(self, chunk: str) -> tuple[str, int, str]:
        head = chunk[:-1]
        if chunk[-1] in ".," and head and head[-1].isalpha():  # the mark is a pre-token of its own
            a, b = self.memo.get(head) or self._entry(head), self.memo.get(chunk[-1]) or self._entry(chunk[-1])
            return f"{a[0]} {b[0]}", a[1] + b[1], f"{a[2]} {b[2]}"
        ids = [i for piece in (self.split.findall(chunk) if not chunk.isalpha() else (chunk,)) for i in self.encode_piece(piece)]
        if len(self.memo) >= MEMO:
            self.forget()
        made = self.memo[chunk] = (" ".join(map(str, ids)), len(ids), " ".join([self.token[i] for i in ids]))
        return made

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by one space, how many, decoded text). Without a decoder in the file, decoding joins tokens by one space."""
        got, entry = self.memo.get, self._entry
        parts = self.specials.split(text or "") if self.specials and "<|" in (text or "") else [text or ""]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append((str(self.special[part]), 1, part))
            else:
                found += [got(c) or entry(c) for c in self.chunks(part) if c]
        return " ".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


def _classes(kind: str) -> str:
    """A character class with all code points whose general category starts with kind."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids array<int> (if asked for), ids_sha256, decoded_sha256 of every row."""
    bound_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        gc.disable()  # the memos hold no cycles, and walking them again and again costs more than all else
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for at, texts in text_batches(batch, "text"):  # what is held is bounded by characters, not rows
                n, ids_sha, decoded_sha, ids = [], [], [], []
                for text in texts:
                    joined, count, decoded = tokenizer.encode(text)
                    n.append(count)
                    ids_sha.append(sha(joined))
                    decoded_sha.append(sha(decoded))
                    if with_ids:
                        ids.append(np.array(joined.split(), np.int32))
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        tokenizer.forget()
        tokenizer.fits.clear()
        trim()  # the worker lives on and has other tasks

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
