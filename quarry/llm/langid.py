"""Language identification with a byte convolutional network.

Filters of several widths run over the UTF-8 bytes of fixed-length windows; each filter's largest response in a window
feeds a softmax over the languages. The network is trained in numpy on the driver from labelled windows and applied to
batched windows that tile every whole text; a text's scores are the mean of its windows' log probabilities.

A byte only ever adds one row of a table to a filter's response, so at prediction time the responses are sums of
looked-up rows, for pairs of bytes where the width allows it. That changes nothing in the result.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text when there is nothing to
learn from. Texts of any length are read whole, their windows a group at a time. Repeated rows give repeated results; an
empty table gives an empty table; only id and text are read, and other columns are handed on, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, bucket_of, trim

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
#: The fit's only bounds: labelled windows that the driver trains on, per language and in all (256 bytes each).
SAMPLE_PER_LANGUAGE, SAMPLE = 1500, 60_000
#: What a document's score must have of the way from chance (one in the number of languages) to certainty for identify() to keep it.
LEAST_SHARE = 0.1
#: Languages the model can tell apart; beyond it the fit refuses rather than drop one.
MOST_LANGUAGES = 1000
STEPS, BATCH, RATE = 500, 64, 4e-3


def windows(raw: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW, the last padded with zeros. A short rest joins no other row: it is a row of its own."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"emb": f(256, DIM, k=0.5), "out": f(len(WIDTHS) * FILTERS, len(languages), k=0.1), "ob": np.zeros(len(languages), np.float32)}
        self.p |= {f"w{w}": f(w * DIM, FILTERS, k=(w * DIM) ** -0.5) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["emb"][x]
        pooled, where, cols = [], [], []
        for w in WIDTHS:
            col = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * DIM)
            z = col @ self.p[f"w{w}"] + self.p[f"b{w}"]
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            where.append(at)
            cols.append(col)
        h = np.concatenate(pooled, 1)
        return np.maximum(h, 0), h > 0, where, cols

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on the cross entropy of single windows."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            pick = r.integers(0, len(x), BATCH)
            xb, yb = x[pick], y[pick]
            h, on, where, cols = self._forward(xb)
            s = h @ self.p["out"] + self.p["ob"]
            s = np.exp(s - s.max(1, keepdims=True))
            d = s / s.sum(1, keepdims=True)
            d[np.arange(BATCH), yb] -= 1
            d /= BATCH
            g = {"out": h.T @ d, "ob": d.sum(0), "emb": np.zeros_like(self.p["emb"])}
            dh = (d @ self.p["out"].T) * on
            for i, w in enumerate(WIDTHS):
                dz = dh[:, i * FILTERS : (i + 1) * FILTERS]
                best = np.take_along_axis(cols[i], where[i][:, :, None], 1)  # batch, filter, w * DIM
                g[f"w{w}"] = np.einsum("bfk,bf->kf", best, dz)
                g[f"b{w}"] = dz.sum(0)
                back = (dz[:, :, None] * self.p[f"w{w}"].T[None]).reshape(BATCH, FILTERS, w, DIM)
                spots = where[i][:, :, None] + np.arange(w)
                np.add.at(g["emb"], xb[np.arange(BATCH)[:, None, None], spots], back)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def tables(self) -> None:
        """Rows for pairs (high byte first) and for single bytes, per width."""
        by = {w: [self.p["emb"] @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.first = np.concatenate([pair(by[w][0], by[w][1]) for w in WIDTHS], 1)
        self.third = by[3][2]
        self.second = pair(by[4][2], by[4][3])
        self.bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Of each window (rows of bytes)."""
        if not hasattr(self, "first"):
            self.tables()
        out = []
        for at in range(0, len(x), 256):
            b = x[at : at + 256].astype(np.int32)
            pairs = (b[:, :-1] << 8) | b[:, 1:]
            z = self.first[pairs]
            h2 = z[:, :, :FILTERS].max(1)
            h3 = (z[:, :-1, FILTERS : 2 * FILTERS] + self.third[b[:, 2:]]).max(1)
            h4 = (z[:, :-2, 2 * FILTERS :] + self.second[pairs[:, 2:]]).max(1)
            h = np.maximum(np.concatenate([h2, h3, h4], 1) + self.bias, 0)
            s = h @ self.p["out"] + self.p["ob"]
            s -= s.max(1, keepdims=True)
            out.append(s - np.log(np.exp(s).sum(1, keepdims=True)))
        return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """Train on one window, at a hashed place, of a hashed sample of the labelled rows: SAMPLE_PER_LANGUAGE each, SAMPLE in all."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).alias("l")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    per_language = min(SAMPLE_PER_LANGUAGE, SAMPLE // len(counts))
    # Rows of a language are taken with the probability that gives somewhat more than the bound; the limit below trims.
    share = F.create_map(*[F.lit(v) for l, n in counts.items() for v in (l, min(1.0, 1.3 * per_language / n))])
    hashed = F.xxhash64(F.col(id_col), F.length(text_col))
    picked = rows.where(F.pmod(hashed, F.lit(1 << 20)) / float(1 << 20) < share[F.col(label_col)])
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.greatest(F.length(text_col) - WINDOW, F.lit(1)).cast("long")).cast("int") + 1
    sample = picked.select(F.col(label_col).alias("l"), F.col(text_col).substr(start, F.lit(WINDOW)).alias("t"), hashed.alias("h"))
    got = sample.orderBy("h", "l", "t").limit(int(1.5 * per_language * len(counts)) + 1000).collect()
    languages = sorted(counts)
    x = np.stack([windows((r["t"] or "").encode()[:WINDOW])[0] for r in got])
    y = np.array([languages.index(r["l"]) for r in got])
    # Each language weighs alike: draw as many windows of each.
    r = np.random.default_rng(11)
    per = [np.flatnonzero(y == k) for k in range(len(languages))]
    even = np.concatenate([r.choice(p, per_language, replace=len(p) < per_language) for p in per if len(p)])
    net = Network(languages)
    net.train(x[even], y[even])
    return net


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, lang_pred and score (or as names call them) of every row."""
    made = names
    bound_batches(docs.sparkSession)
    spec = None if net is None else (net.languages, net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if spec is not None:
            model = Network(spec[0])
            model.p = spec[1]
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            group: list[np.ndarray] = []
            owner: list[int] = []

            def flush() -> None:
                if not group:
                    return
                lp = model.log_probs(np.concatenate(group))
                at = np.concatenate(([0], np.cumsum([len(g) for g in group])))[:-1]
                mean = np.add.reduceat(lp, at) / np.array([[len(g)] for g in group])
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                for i, p in zip(owner, prob):
                    langs[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
                group.clear()
                owner.clear()

            size = 0
            for i, text in enumerate(batch.column(len(keep))):
                t = text.as_py()
                if model is None or not has_letter(t):
                    continue
                group.append(windows(t.encode("utf-8", "surrogatepass")))
                owner.append(i)
                size += len(group[-1])
                if size >= 2048:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
        del model
        trim()

    names = [f"c{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "lang_pred string, score double"])
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("t"))
    out = read.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("lang_pred").alias(made[0]), F.col("score").alias(made[1]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(bucket_of("doc_id", 4) != 2))
    return predict(docs, net, ["doc_id"]).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """documents without those whose language cannot be told, all columns as they were: `und`, or a prediction hardly better than chance."""
    net = fit(docs.where(bucket_of("doc_id", 4) != 2))
    if net is None:
        return docs.where("false")
    chance = 1 / len(net.languages)
    lang, score = ("_".join((*docs.columns, n)) for n in ("lang_pred", "score"))  # names that no column has
    told = predict(docs, net, docs.columns, names=(lang, score))
    return told.where((F.col(lang) != "und") & (F.col(score) >= chance + least * (1 - chance))).select(*docs.columns)
