"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean trigram query is derived (what any match must
contain). A segment of documents is indexed: for every trigram that a query names, the postings are the positions of
the documents that contain it (case folded for ASCII). AND and OR intersect and merge postings; only candidates are
scanned with the regular expression. A rule without mandatory trigrams (the hex rule) scans every document.

Defined cases: a null text counts as empty and has no spans (redacting leaves it null); repeated rows give repeated
results; an empty table gives an empty table; other columns of the input are not read, so clashing names do no harm; a
private key without its END line is one span up to the end of its BEGIN line. Memory is that of one Arrow batch, or of one
text longer than that, which is scanned whole. Spans are in code points, end exclusive, found leftmost and non-overlapping per kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

try:
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants
    import sre_parse as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches

#: kind, pattern, group that holds the value, least length of that group. The first three are fixed by contract.
BASE = [
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: What the method adds: well-known credential formats.
ADDED = [
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    # With its body and END line, if they follow before another BEGIN.
    ("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----(?:(?:(?!-----BEGIN)[A-Za-z0-9+/=:,.\\\x20\x09\x0A\x0D-])*?-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----)?", 0, 27),
]
RULES = BASE + ADDED
_MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """A conjunction of disjunctions: every match contains, for each set, all trigrams of at least one string in it.

    Each member of a set is one literal alternative; None if the pattern forces no string of three characters.
    """
    clauses: list[set[str]] = []

    def literals(items) -> set[str] | None:
        """All strings an item sequence can match, if few and finite."""
        out = {""}
        for op, arg in items:
            if op is sre_constants.LITERAL:
                new = {chr(arg)}
            elif op is sre_constants.IN and all(o is sre_constants.LITERAL for o, _ in arg):
                new = {chr(a) for _, a in arg}
            elif op is sre_constants.SUBPATTERN:
                new = literals(arg[3])
            elif op is sre_constants.BRANCH:
                alts = [literals(x) for x in arg[1]]
                new = None if any(a is None for a in alts) else set().union(*alts)
            elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[1] <= 3:
                one = literals(arg[2])
                new = None if one is None else set()
                for n in range(arg[0], arg[1] + 1) if one is not None else ():
                    made = {""}
                    for _ in range(n):
                        made = {a + b for a in made for b in one}
                    new |= made
            else:
                new = None
            if new is None:
                return None
            out = {a + b for a in out for b in new}
            if len(out) > _MOST_STRINGS:
                return None
        return out

    def visit(items) -> None:
        run: list = []

        def flush() -> None:
            if run:
                found = literals(run)
                if found and all(len(s) >= 3 for s in found):
                    clauses.append(found)
            run.clear()

        for item in items:
            op, arg = item
            if literals([item]) is not None:
                run.append(item)
                found = literals(run)
                if found is None:
                    run.pop()
                    flush()
                    run.append(item)
                continue
            flush()
            if op is sre_constants.SUBPATTERN:
                visit(arg[3])
            elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0] >= 1:
                visit(arg[2])
        flush()

    visit(list(sre_parser.parse(pattern)))
    return [frozenset(s.lower() for s in c) for c in clauses] or None


def _trigrams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


class TrigramIndex:
    """Postings of the trigrams that some query names, over one segment of documents."""

    def __init__(self, texts: list[str], wanted: set[str]):
        folded = [t.lower() for t in texts]  # ASCII letters map as in the queries; others can only add candidates
        self.n = len(texts)
        self.postings = {g: {i for i, t in enumerate(folded) if g in t} for g in wanted}

    def candidates(self, query: list[frozenset[str]] | None) -> list[int]:
        if query is None:
            return list(range(self.n))
        found: set[int] | None = None
        for clause in query:
            hit: set[int] = set()
            for s in clause:
                lists = sorted((self.postings[g] for g in _trigrams(s)), key=len)
                hit |= set.intersection(*lists)
            found = hit if found is None else found & hit
        return sorted(found or ())


def compile_rules(rules=RULES) -> list[tuple]:
    """(kind, compiled pattern, group, least length, query, run).

    A maximal run of one ASCII class is compiled with its least length, which gives the same spans; run then holds a
    table that maps the class to one byte, so that a text without such a run is told at once.
    """
    out = []
    for kind, pattern, group, least in rules:
        query = trigram_query(pattern)
        run = re.fullmatch(r"(\[[^\]]+\])\+", pattern)
        table = bytes(bool(run and b < 128 and re.fullmatch(run[1], chr(b))) for b in range(256))
        out.append((kind, re.compile(f"{run[1]}{{{least},}}" if run else pattern), group, least, query, table if run else None))
    return out


def spans_of(text: str, rule: tuple) -> list[tuple[int, int]]:
    _, pattern, group, least, _, run = rule
    if run is not None and bytes([1]) * least not in text.encode("ascii", "replace").translate(run):
        return []
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def scan_segment(texts: list[str | None], rules: list[tuple]) -> list[list[tuple[int, int, str, int]]]:
    """For each text its spans as (start, order of the kind, kind, end), sorted."""
    texts = [t or "" for t in texts]
    index = TrigramIndex(texts, {g for r in rules if r[4] for c in r[4] for s in c for g in _trigrams(s)})
    found: list[list] = [[] for _ in texts]
    for order, rule in enumerate(rules):
        for i in index.candidates(rule[4]):
            found[i] += [(s, order, rule[0], e) for s, e in spans_of(texts[i], rule)]
    for f in found:
        f.sort()
    return found


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans array<struct<kind, start, end>> of every row, by start and then by the order of the kinds."""
    bound_batches(docs.sparkSession)
    rules = list(rules)
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in f] for f in scan_segment(texts, compiled)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind_of_id}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """documents with every span (overlapping ones merged) replaced by mark; rows without spans are unchanged."""
    bound_batches(docs.sparkSession)
    rules, schema = list(rules), docs.schema
    at = schema.fieldNames().index("text")
    n_at = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sizes = batch.column(n_at).to_pylist() if n_at is not None else None
            for i, f in enumerate(scan_segment(texts, compiled)):
                if not f:
                    continue
                out, end = [], 0
                for s, _, _, e in f:
                    if s >= end:
                        out += [texts[i][end:s], mark]
                    end = max(end, e)
                texts[i] = "".join([*out, texts[i][end:]])
                if sizes is not None:
                    sizes[i] = len(texts[i])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            if n_at is not None:
                arrays[n_at] = pa.array(sizes, batch.column(n_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document: counts by base kind, digest of the base spans, all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [k for k, *_ in BASE]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, base), F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
