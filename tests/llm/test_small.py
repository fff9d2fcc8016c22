"""Each operator on small fixtures against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quarry.llm import bpe, common, decontaminate, graph, html, jaccard, katz, langid, rollups, secrets, topk, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


WORDS = "the of and to in a tion erhe andoin thren stole quick brown fox jumps".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "x", "yz", str(r.randrange(50))]) for _ in range(n))


ODD = [None, "", "   \n\t", "Ä ß 日本 🎉", "x", "the of", "THE  of\x0band", "a\x00b\x1cc\x85d", "w " * 5000]


# Secrets.
def brute_spans(text):
    text, out = text or "", []
    for order, (kind, pattern, group, least) in enumerate(secrets.RULES):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(spark):
    texts = [*ODD, "é password = 'hunter22' token:abc secret=token=abcdefgh APIKEY:zzzzzz api_key\": \"qwertyu", "AKIA" + "Z9" * 10 + " AKIAshort", "0123456789abcdef" * 3 + "g" + "ab" * 11, "K" * 3 + "toKen=abcdefgh ſecret=abcdefgh", "xoxb-0123456789ab ghp_" + "a" * 36]
    rows = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.scan(docs_of(spark, texts).withColumn("spans", common.F.lit(1))).collect()}
    assert rows == {i: [(s, k, e) for s, _, k, e in brute_spans(t)] for i, t in enumerate(texts)}
    clean = {r.doc_id: r for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert len(clean) == len(texts) and clean[0].text is None and "hunter22" not in clean[len(ODD)].text and clean[len(ODD)].n_chars == len(clean[len(ODD)].text)
    assert secrets.scan(docs_of(spark, [])).count() == 0


def test_private_keys_go_whole(spark):
    body = "MIIEvQ+/=\nabcDEF012\r\n"
    text = f"a -----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY----- b -----BEGIN PRIVATE KEY-----\nopen -----BEGIN EC PRIVATE KEY-----{body}-----END EC PRIVATE KEY-----"
    assert secrets.redact(docs_of(spark, [text])).first().text == "a [secret] b [secret]\nopen [secret]"


@pytest.mark.parametrize("rule, query", [("hex", None), ("access", [frozenset({"akia"})]), ("slack", [frozenset(f"xox{c}-" for c in "abprs")])])
def test_trigram_queries(rule, query):
    assert next(r[4] for r in secrets.compile_rules() if r[0] == rule) == query


# BPE.
def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe.default_path())
    reference.no_truncation()
    reference.no_padding()
    r = random.Random(4)
    texts = [*ODD, "<|endoftext|> hi <|startoftext|>x <|nope|>", "ΣΑΣ İ ½ x² it's can't'll é", "a" * 700, "don't., ''s 's", "　a᠎b"]
    texts += ["".join(r.choice("abcdeéßñ .,'19Ⅷ\n") for _ in range(60)) for _ in range(100)]
    for row in bpe.encode(docs_of(spark, texts)).collect():
        want = reference.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(reference.decode(want, skip_special_tokens=False).encode()).hexdigest()


# Jaccard.
def brute_components(texts, k=3, percent=90):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, k, percent):
    r = random.Random(k)
    texts = list(ODD)
    for n in (1, 3, 9, 12, 25, 60, 150):
        base = prose(r, n).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = prose(r, 1)
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    texts += texts[-3:]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs_of(spark, texts), k, percent).collect()}
    assert got == brute_components(texts, k, percent)
    kept = jaccard.deduplicate(docs_of(spark, texts), k, percent)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (_, c) in got.items() if c == i)


def test_jaccard_odd_tables(spark):
    assert jaccard.join(docs_of(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (0, "a b c d")], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.component_id) for x in jaccard.join(rows.where("doc_id is not null")).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert [x.component_id for x in jaccard.join(rows).where("doc_id is null").collect()] == [None]


def test_large_cluster_in_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "GATHER", 50)
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    r = random.Random(1)
    base = prose(r, 80).split()
    texts = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(0, 80)] + [" ".join(base)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("k, percent", [(1, 80), (2, 80), (3, 90)])
def test_jaccard_takes_chained_clusters_apart(spark, monkeypatch, k, percent):
    """what agrees in a range by chance does not meet in pairs of cells, and no link is lost, of large groups either."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40 if k == 1 else 9)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(100)]
    family = rng.choices([f"v{i}" for i in range(500)], k=60)
    for _ in range(20):  # a group beyond COMMON and CELL
        family = [*family]
        family[rng.randrange(60)] = f"u{rng.random()}"
        texts.append(" ".join(family))
    for text in texts[:20]:
        texts.append(f"{text} {rng.choice(words)}")
    monkeypatch.setattr(jaccard, "CELL", 8)
    cells = []

    def cut(df, name):
        out = common.cut(df, name)
        if name == "jaccard-sizes":
            cells.append({x.cluster: x.cells for x in out.collect()})
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    rows = docs_of(spark, texts)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(rows.unionByName(rows.where("doc_id % 3 = 0")), k, percent).collect()}
    assert got == brute_components(texts, k, percent)
    if k < 3:
        assert sum(c * c for c in cells[-1].values() if c > 1) < sum(c * c for c in cells[0].values() if c > 1) / 2


def test_pairs_of_keys_over_batches():
    """The same rows, in batches of any size: pairs of keys of few nodes, a mark for each node of a commoner key."""
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(n), 1) for k, n in zip(rng.integers(0, 30, 300) ** 2 // 30, rng.integers(0, 400, 300))})
    by: dict[int, list[int]] = {}
    for k, n, _ in rows:
        by.setdefault(k, []).append(n)
    want = Counter()
    for ns in by.values():
        want.update(((n, None), -1) for n in ns) if len(ns) > jaccard.COMMON else want.update(((a, b), 1) for i, a in enumerate(ns) for b in ns[i + 1 :])
    rows = [x for r in rows for x in (r, r)]
    for step in (1, 3, 7, 1000):
        batches = [jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array([r[i] for r in rows[at : at + step]], t) for i, t in enumerate((jaccard.pa.int64(), jaccard.pa.int64(), jaccard.pa.int32()))] + [jaccard.pa.nulls(len(rows[at : at + step]), jaccard.pa.int32())], names=["key", "node", "band", "need"]) for at in range(0, len(rows), step)]
        got = Counter()
        for out in jaccard._pairs(iter(batches)):
            for a, b, _, n in zip(*(c.to_pylist() for c in out.columns)):
                got[(a, b), 1 if n > 0 else -1] += abs(n)
        assert got == want, step


@pytest.mark.parametrize("cell", [8, 1024])
def test_jaccard_numbers_of_links(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    r = random.Random(4)
    base = prose(r, 80).split()
    texts = [" ".join([*base[:i], *["changed"] * (i % 3), *base[i + i % 3 :]]) for i in range(0, 60)] + [" ".join(base)] * 3 + ["", None, "x"]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w := (t or "").split()) > 2 else set(w) for t in texts]
    want = {i: sum(i != j and bool(a) and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    rows = docs_of(spark, texts)
    got = jaccard.join(rows.unionByName(rows.where("doc_id = 0")).unionByName(rows.where("doc_id = 5").withColumn("doc_id", common.F.lit(None).cast("long")))).collect()
    assert {x.doc_id: x.n_links for x in got} == {**want, None: 0} and len(got) == len(texts) + 2
    assert len({want[i] for i in range(60)}) > 1


def test_rtree_equals_all_pairs():
    r = np.random.default_rng(0)
    sizes = r.integers(5, 60, 300)
    points = np.stack([np.bincount(r.integers(0, 8, n), minlength=8) for n in sizes]).astype(np.int32)
    tree = jaccard.RTree(points, sizes)
    who, at, bound = tree.query(points, sizes, 80)
    want = {(i, j): int(np.minimum(points[i], points[j]).sum()) for i in range(300) for j in range(300) if 180 * np.minimum(points[i], points[j]).sum() >= 80 * (sizes[i] + sizes[j])}
    assert dict(zip(zip(who.tolist(), at.tolist()), bound.tolist())) == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == root
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Decontamination.
def test_decontamination(spark):
    r = random.Random(5)
    items = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n)) for n in (1, 2, 5, 15, 40, 59)] + [None, ""]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    texts = [*ODD]
    want = set()
    for i, t in enumerate(items[:6]):
        want.add((len(texts), i))
        texts.append(prose(r, 300) + " " + t.upper().replace(" ", "\n") + " " + prose(r, 20))
    for i in (3, 4, 5):
        w = items[i].split()
        w[len(w) // 3] = "other"
        want.add((len(texts), i))
        texts.append(prose(r, 30) + " " + " ".join(w) + " " + prose(r, 30))
    texts.append(" ".join(items[5].split()[:20]))  # a third of an item is not the item
    got = {(x.doc_id, x.item_id) for x in decontaminate.scan(docs_of(spark, texts), bench).collect()}
    assert {g for g in got if g[1] > 1} == {w for w in want if w[1] > 1} and got >= want
    kept = {x.doc_id for x in decontaminate.clean(docs_of(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.scan(docs_of(spark, texts), bench.where("false")).count() == 0
    assert decontaminate.clean(docs_of(spark, []), bench).count() == 0


def test_nearest_is_exact():
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(n)).encode() for n in (r.randrange(1, 9), r.randrange(0, 25)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        best = min(row)
        got = decontaminate.nearest(a, b, len(a))
        assert (got[0] if got else len(a)) == best if best < len(a) else True


def test_recall_of_edited_passages():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    items = [" ".join(r.choice(words) for _ in range(r.randrange(15, 60))) for _ in range(100)]
    edited = [" ".join(r.choice(words) if r.random() < 0.08 else w for w in t.split()) for t in items]
    index = decontaminate.Items(list(enumerate(items)))
    hits = index.find([" ".join(r.choice(words) for _ in range(80)) + " " + t for t in edited])
    near = [decontaminate.nearest(t.encode(), e.encode(), int(0.2 * len(t))) is not None for t, e in zip(items, edited)]
    assert sum(any(h[0] == i for h in hit) for i, hit in enumerate(hits)) >= 0.95 * sum(near)


def typo(r, w):
    i = r.randrange(len(w))
    return w[:i] + r.choice("qrstuvwxyz") + w[i + 1 :]


def edits(r, t):
    c = list(t)
    for i in r.sample(range(len(c)), len(c) // 5):
        x = r.choice("qrstuvwxyz")
        c[i] = r.choice(["", x, c[i] + x])
    return "".join(c)


def recall(r, items, edited):
    near = [i for i, (t, e) in enumerate(zip(items, edited)) if decontaminate.nearest(t, e, int(0.2 * len(t) + 1e-9)) is not None]
    hits = decontaminate.Items(list(enumerate(items))).find([f"{prose(r, 40)} {e} {prose(r, 40)}" for e in edited])
    assert len(near) > len(items) // 2
    return sum(any(h[0] == i for h in hits[i]) for i in near) / len(near)


def made_up(r, n, count):
    return [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n)) for _ in range(count)]


@pytest.mark.parametrize("n", [1, 2, 4, 8, 16, 40])
def test_recall_down_to_the_limit(n):
    r = random.Random(n)
    items = made_up(r, n, 100)
    assert recall(r, items, [edits(r, t) for t in items]) >= 0.9
    assert recall(r, items, [" ".join([typo(r, t.split()[0]), *t.split()[1:]]) for t in items]) >= 0.9


@pytest.mark.parametrize("n, share", [(16, 0.8), (40, 0.8), (16, 1.0), (40, 1.0)])
def test_recall_where_few_words_agree(n, share):
    r = random.Random(n)
    items = made_up(r, n, 100)
    assert recall(r, items, [" ".join(typo(r, w) if r.random() < share else w for w in t.split()) for t in items]) >= 0.9


def test_items_with_names_and_in_blocks(spark, monkeypatch):
    r = random.Random(21)
    items = made_up(r, 12, 6)
    bench = spark.createDataFrame([(f"i{n}", t) for n, t in enumerate(items)] + [(None, items[0]), ("x", None), ("y", "")], "item_id string, text string")
    docs = docs_of(spark, [*ODD, *[f"{prose(r, 9)} {t} {prose(r, 5)}" for t in items]]).withColumn("item_id", common.F.lit(1)).withColumn("distance", common.F.lit(1))
    order = lambda x: (x.doc_id, str(x.item_id))
    whole = sorted(decontaminate.scan(docs, bench).collect(), key=order)
    assert [(x.doc_id - len(ODD), x.item_id) for x in whole if x.item_id] == [(n, f"i{n}") for n in range(6)] and [x.doc_id for x in whole if not x.item_id] == [len(ODD)]
    kept = decontaminate.clean(docs, bench)
    assert {x.doc_id for x in kept.collect()} == set(range(len(ODD))) and kept.columns == docs.columns
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert sorted(decontaminate.scan(docs, bench).collect(), key=order) == whole
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} == set(range(len(ODD)))
    assert decontaminate.scan(docs.where("false"), bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == docs.count()


@pytest.mark.parametrize("gap", [" ", ""])
def test_long_texts_are_searched_in_pieces(monkeypatch, gap):
    r = random.Random(22)
    items = made_up(r, 10, 8)
    text = prose(r, 3000).replace(" ", gap or "_")
    for t in items:
        at = r.randrange(len(text))
        text = text[:at] + " " + t + " " + text[at:]
    index = decontaminate.Items(list(enumerate(items)))
    whole = index.find([text])[0]
    monkeypatch.setattr(decontaminate, "LONG", 500)
    assert index.find([text, None])[0] == whole and {h[0] for h in whole if not h[1]} >= set(range(7))


def test_distances_count_characters(spark):
    item = "la acción según él está aquí así también allí mañana café día niño más río corazón jardín"
    plain = item.translate(str.maketrans("áéíóúñ", "aeioun"))
    far = "".join("z" if i % 4 == 0 and c != " " else c for i, c in enumerate(item))
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    rows = decontaminate.scan(docs_of(spark, [f"uno dos {plain} tres", f"uno dos {far} tres"]), bench).collect()
    assert [(x.doc_id, x.item_id, x.distance, x.item_chars, x.first_word, x.n_words) for x in rows] == [(0, 0, sum(a != b for a, b in zip(item, plain)), len(item), 2, len(item.split()))]


# Katz.
def test_katz(spark):
    from brute_katz import scores

    r = random.Random(6)
    texts = [*ODD, *[prose(r, r.randrange(1, 120)) for _ in range(120)], "the of", "the of"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want = scores([t for t, h in zip(texts, held) if not h], texts)
    rows = katz.score(docs_of(spark, texts).repartition(3), common.bucket_of("doc_id", 7) == 2).collect()
    assert len(rows) == len(texts)
    for row in rows:
        w = want[row.doc_id]
        assert row.held_out == held[row.doc_id] and [row[k] for k in ("n_tokens", "n_known", "train_tokens")] == [w[k] for k in ("n_tokens", "n_known", "train_tokens")]
        assert row.base_score == pytest.approx(w["base_score"]) and row.score == pytest.approx(w["score"])
    assert katz.score(docs_of(spark, []), common.F.lit(False)).count() == 0
    untrained = katz.score(docs_of(spark, ["a b"]), common.F.lit(True)).collect()[0]
    assert (untrained.n_known, untrained.train_tokens, untrained.base_score, untrained.score) == (0, 0, 0.0, 0.0)


def test_a_fitted_model_scores_later_documents(spark, tmp_path, monkeypatch):
    from brute_katz import scores

    monkeypatch.setattr(katz, "PER_BUCKET", 40)  # many buckets
    monkeypatch.setattr(katz, "HOT", 6)
    r = random.Random(16)
    train = [prose(r, r.randrange(0, 60)) for _ in range(60)] + ["the of " * 300, "the of " * 300]
    later = [*ODD, "the of the of", "unheard of", *[prose(r, 30) for _ in range(20)]]
    table = docs_of(spark, train).withColumn("key", common.F.lit("k")).withColumn("kind", common.F.lit(1))
    katz.fit(table, common.F.lit(False), f"file://{tmp_path}/m")
    model = katz.Katz(spark, f"file://{tmp_path}/m")
    assert model.buckets > 8 and len(model.hot) <= 6
    want = scores(train, later)
    rows = docs_of(spark, later)
    got = model.score(rows.unionByName(rows.where("doc_id = 1").withColumn("doc_id", common.F.lit(None).cast("long"))), common.F.lit(True)).collect()
    assert len(got) == len(later) + 1 and all(x.held_out for x in got)
    for x in got:
        w = want[1 if x.doc_id is None else x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (w["n_tokens"], w["n_known"], w["train_tokens"])
        assert x.base_score == pytest.approx(w["base_score"]) and x.score == pytest.approx(w["score"])
    pairs = model.bigrams().agg(common.F.sum("n"), common.F.count("*"), common.F.count_distinct("word", "history")).first()
    assert pairs[0] == want[0]["train_tokens"] and pairs[1] == pairs[2]


def test_columns_are_numbers_only():
    columns = [np.arange(5, dtype=np.uint16), np.array([], np.uint64), np.array([0.5, -1.0]), np.array([-3])]
    _, _, size, blob = katz._pack("x", 1, *columns)
    back = katz._unpack(size, blob)
    assert [c.dtype for c in back] == [c.dtype for c in columns] and all(np.array_equal(a, b) for a, b in zip(back, columns))


# Language.
def test_language(spark):
    r = random.Random(8)
    make = {"xx": "abcdab", "yy": "wzyqxw"}
    rows = [(i, " ".join("".join(r.choice(make[la]) for _ in range(5)) for _ in range(r.randrange(5, 200))), la) for i, la in enumerate(["xx", "yy"] * 60)]
    rows += [(200, None, "xx"), (201, "123 !!", "yy"), (202, "", None), (203, rows[0][1], None), (203, rows[0][1], None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(table)
    got = [(x.doc_id, x.lang_pred, x.score) for x in langid.predict(table, net, ["doc_id"]).collect()]
    truth = {i: la for i, _, la in rows[:120]} | {203: "xx"}
    assert len(got) == len(rows) and all(p == truth.get(i, "und") and 0 <= s <= 1 for i, p, s in got)
    assert {i for i, p, s in got if s == 0} == {200, 201, 202}
    assert {x.lang_pred for x in langid.predict(table, langid.fit(table.where("false")), ["doc_id"]).collect()} == {"und"}
    x = langid.windows(rows[0][1].encode())
    h, *_ = net._forward(x)
    s = h @ net.p["out"] + net.p["ob"]
    s -= s.max(1, keepdims=True)
    assert np.allclose(net.log_probs(x), s - np.log(np.exp(s).sum(1, keepdims=True)), atol=1e-3)


# WARC.
def test_warc_round_trip_over_split_ranges(spark, tmp_path):
    r = random.Random(1)
    noise = "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(60_000))
    pages = [(i, f"http://h/{i} x", prose(r, 200) if i % 3 else "same") for i in range(60)] + [(100, None, None), (101, "http://e", ""), (102, "http://big", noise), (103, "http://big2", noise)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(table, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {x.page_id: x for x in warc.records(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(pages)
    for i, _, text in pages:
        raw = (text or "").encode()
        owner = max(j for j, _, t in pages if (t or "") == (text or ""))
        x = got[i]
        assert (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) == (len(raw), warc.base32_sha1(raw), "response" if i == owner else "revisit", None if i == owner else owner)
        assert x.payload == (raw if i == owner else None)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/w").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") == len(pages)


def test_false_magic_within_members():
    data = warc.record_bytes(1, "u", b"x" * 500, None, False)
    member = bytearray(warc._member(data))
    stored = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
    # A stored block holds the magic as it is.
    body = warc.record_bytes(2, "u", b"<" + warc.MAGIC + b"\x00" * 30 + warc.MAGIC, None, False)
    z = zlib.compressobj(0, zlib.DEFLATED, -15)
    second = stored + z.compress(body) + z.flush() + struct.pack("<II", zlib.crc32(body), len(body))
    pieces = (bytes(member) + second + bytes(member)).split(warc.MAGIC)[1:]
    assert [warc.parse_record(d)["page_id"] for k, d in warc._split_range(pieces) if k == "record"] == [1, 2, 1]
    kinds = [k for k, _ in warc._split_range(pieces[:2])] + [k for k, _ in warc._split_range(pieces[2:])]
    assert kinds[:2] == ["record", "tail"] and "head" in kinds


def test_records_of_other_writers():
    body = b"<html>caf\xc3\xa9</html>"
    head = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:uuid:1>\r\nWarc-Target-Uri:http://h/x\r\nContent-type: application/http; msgtype=response\r\nWARC-Payload-Digest: SHA1:%s\r\n"
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    for digest, ok in ((warc.base32_sha1(body).encode(), True), (warc.base32_sha1(b"").encode().lower(), False)):
        got = warc.parse_record(head % digest + b"CONTENT-LENGTH: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
        assert (got["page_id"], got["url"], got["record_type"], got["payload"], got["payload_bytes"], got["digest_ok"]) == (None, "http://h/x", "response", body, len(body), ok)
    bare = warc.parse_record(b"WARC/1.1\r\nWARC-Type: revisit\r\n\r\n")
    assert (bare["record_type"], bare["payload_bytes"], bare["payload_digest"], bare["payload"]) == ("revisit", None, None, None)
    own = warc.record_bytes(None, "u", b"x", None, False, "2024-01-02T03:04:05Z")
    assert b"WARC-Date: 2024-01-02T03:04:05Z\r\n" in own and b"WARC-Record-ID: <urn:uuid:" in own and warc.parse_record(own)["page_id"] is None


def test_archive_of_nothing(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "h", "p", "k")], "page_id bigint, url string, html string, payload string, key string")
    warc.write(table.where("false"), f"file://{tmp_path}/none")
    assert warc.records(spark, f"file://{tmp_path}/none").count() == 0
    warc.write(table, f"file://{tmp_path}/one")
    assert [(x.page_id, x.payload, x.digest_ok) for x in warc.records(spark, f"file://{tmp_path}/one").collect()] == [(1, b"h", True)]


# HTML.
def test_html(spark):
    body = '<html><head><title>T</title><style>x</style><script>if(a<b)"</p>"</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; small</h1><p>One\n two&nbsp;three<p>Four <b>five<br>six</article><div id="comments"><p>Nice post, really, I liked it very much.</p></div><form>Send</form><footer>&copy; x</footer></body></html>'
    pages = [(1, "http://h/a", body), (2, "http://h/b", body.replace("Four", "Vier")), (3, "http://h/c", None), (4, None, ""), (5, "http://q", "<p>Only text, and nothing else around it."), (6, "http://h/d", "<!-- open <p>x"), (6, "http://h/d", "<div><<p>odd < 3 &lt; 4</div></p></p>")]
    table = spark.createDataFrame([(*p, "t") for p in pages], "page_id bigint, url string, html string, text string")
    got = [(x.page_id, x.text, x.n_chars) for x in html.extract(table).collect()]
    assert sorted(got)[:5] == [(1, "Big & small\nOne two three\nFour five six", 39), (2, "Big & small\nOne two three\nVier five six", 39), (3, "", 0), (4, "", 0), (5, "Only text, and nothing else around it.", 38)]
    assert len(got) == 7
    assert html.extract(table.where("false")).count() == 0


def one_page(source):
    page = html.Page(source)
    return page.text(page.best())


@pytest.mark.parametrize(
    "source, text",
    [
        ('<p title="a"b">One</p><p>Two "x" three</p><p>Four</p>', 'One\nTwo "x" three\nFour'),
        ("<div><p title='it's'>One, one.</p><p>Two's</p></div>", "One, one.\nTwo's"),
        ('<p title="open>One</p><p class="x">Two</p>', "One\nTwo"),
        ('<article data-x="<b>q</b> > r" class=a><p hidden>no</p><p class="x" >yes <a href=/x?a=b>in</a></p></article>', "yes in"),
        ("<p a= 'x' =b/>k<br/>l<p/ >m<img src='a>b' alt=x>n<p =>o", "k l\nmn\no"),
        ('<article><header><h1>Big</h1></header><p class="reply">A reply.</p><p class="notice-board">Board</p><p>x <math><mi>y</mi></math> z</p></article>', "Big\nA reply.\nBoard\nx y z"),
        ('<header>top</header><article><p>Text stays.</p><div class="notice">n</div><p class="ad">a</p><ul class="reply"><li>r</ul><footer>f</footer></article>', "Text stays."),
        ("<P>One<P>Two</DIV></P>three &amp; &#x26; &nosuch; <3", "One\nTwo\nthree & & &nosuch; <3"),
        ("<style>a</style><p>b<script>c</p>", "b"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(source, text):
    assert one_page(source) == text


def plain(tree):
    """The blocks of a generated article, straight from its tree."""
    out = []
    for tag, attrs, children in tree:
        if tag == "p":
            out.append(" ".join(" ".join(children).split()))
        elif tag != "aside":
            out += plain(children)
    return [b for b in out if b]


def test_generated_pages():
    """Articles of nested containers, with attributes of every form of quoting, are read block by block."""
    r = random.Random(12)

    def make(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            tag = r.choice(["p", "p", "p", "div", "section", "blockquote", "aside"]) if depth else "p"
            attrs = "".join(" " + r.choice(["class=body", 'class="text b"', "data-a='x>y'", 'title="<q>"', "checked", "a='it's'", 'b="x"y', "'", "c = d"]) for _ in range(r.randrange(3)))
            out.append((tag, attrs, [r.choice(["One two. ", "three\n four, ", "5 ", "a  b ", ""]) for _ in range(3)] if tag == "p" else make(depth - 1)))
        return out

    def markup(tree):
        close = lambda tag: "" if tag == "p" and r.random() < 0.5 else f"</{tag}>"
        return "".join(f"<{tag}{attrs}>" + ("".join(f"<b>{c}</b>" if r.random() < 0.3 else c for c in kids) if tag == "p" else markup(kids)) + close(tag) for tag, attrs, kids in tree)

    for _ in range(200):
        tree = make(3)
        assert one_page(f"<nav><p>away</p></nav><article><p>{'Long text to be found. ' * 60}</p>{markup(tree)}</article>") == "\n".join([("Long text to be found. " * 60).strip(), *plain(tree)])


def test_memory_of_nested_pages():
    import tracemalloc

    source = "<div>" * 4000 + "<p>hello there.</p>" * 2000
    tracemalloc.start()
    assert one_page(source).count("\n") == 1999
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_hosts_beyond_those_sent(spark, monkeypatch):
    monkeypatch.setattr(html, "SENT_HOSTS", 1)
    page = lambda host, cls: f'<div class="{cls}"><p>The article of this page, long enough.</p></div><div class="more"><p>Something else that is rather long, {host}.</p></div>' if cls else "<p>Bare.</p>"
    rows = [(i, f"http://h{i % 3}/{i}", page(i % 3, "main")) for i in range(9)] + [(9, "http://h1/x", page(1, "main")), (10, None, page(0, "")), (11, "http://h2/y", None)]
    table = spark.createDataFrame([(*r, "p") for r in rows], "page_id bigint, url string, html string, path string")
    got = {x.page_id: (x.url, x.text) for x in html.extract(table).collect()}
    monkeypatch.setattr(html, "SENT_HOSTS", 50)
    assert got == {x.page_id: (x.url, x.text) for x in html.extract(table).collect()} and len(got) == 12 and got[10] == (None, "Bare.") and got[11][1] == ""


# Top k.
def test_topk(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 6)).astype(np.float32) * 0.3
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [0.5, 0.5]), (1151, [0.25, 0.25]), (None, [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(v) for v in topk.search(topk.usable(table), common.F.col("vec_id") % 50 == 0).collect())
    q = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(order)]
    want.append((1150, 1, 1151, 128 * 64 * 2))
    assert got == sorted(want)
    assert topk.search(topk.usable(table.where("false")), common.F.lit(True)).count() == 0


# Rollups.
def test_rollups(spark, tmp_path):
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    change = lambda *rows: spark.createDataFrame(rows, rollups.CHANGES)
    totals = lambda: sorted(map(tuple, roll.totals().collect()), key=str)
    assert totals() == [] and roll.ledger().count() == 0
    assert roll.apply("b1", change((0, "insert", 1, "v", "s", "en", 5), (0, "insert", 2, "v", "s", None, 7), (0, "insert", None, "v", "s", "en", 9), (0, "insert", 3, "w", None, "de", None)))
    assert totals() == sorted([("s", "en", "v", 1, 5), ("s", None, "v", 1, 7), (None, "de", "w", 1, 0)], key=str)
    again = change((0, "revise", 1, "v", "t", "en", 6), (1, "revise", 1, "v", "t", "en", 8), (0, "delete", 2, "v", None, None, None), (0, "delete", 9, "v", None, None, None))
    assert roll.apply("b2", again) and not roll.apply("b2", again) and not roll.apply("b1", again)
    assert totals() == sorted([("t", "en", "v", 1, 8), (None, "de", "w", 1, 0)], key=str)
    assert roll.apply("b3", change((0, "x", 1, "v", "a", "b", 1)).where("false")) and roll.apply("b4", change((0, "insert", 2, "v", "s", "en", 1)))
    assert totals() == sorted([("t", "en", "v", 1, 8), ("s", "en", "v", 1, 1), (None, "de", "w", 1, 0)], key=str)
    assert roll.committed() == ["b1", "b2", "b3", "b4"] and rollups.Rollup(spark, f"file://{tmp_path}/r").committed() == roll.committed()
    assert {(r.number, r.source, r.n_docs) for r in roll.deltas().where("version = 'v'").collect()} >= {(0, "s", 1), (1, "s", -1), (1, "t", 1), (3, "s", 1)}


def test_tables_read_before_a_commit_stay(spark, tmp_path):
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r", buckets=4)
    change = lambda *rows: spark.createDataFrame(rows, rollups.CHANGES)
    roll.apply("a/../b ?*", change(*[(0, "insert", i, "v", "s", "en", 1) for i in range(40)]))
    ledger, totals, held = roll.ledger(), roll.totals(), roll._last()["buckets"]
    assert roll.apply("two", change((0, "delete", 7, "v", None, None, None)))
    assert ledger.count() == 40 and totals.first().n_docs == 40 and roll.totals().first().n_docs == 39
    assert sum(held[b] != p for b, p in roll._last()["buckets"].items()) == 1  # one bucket was written anew
    assert not roll.apply("a/../b ?*", change((0, "insert", 99, "v", "s", "en", 1)))
    roll.vacuum()
    assert roll.ledger().count() == 39 and roll.totals().first().n_docs == 39


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    one, two = (rollups.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    change = lambda i: spark.createDataFrame([(0, "insert", i, "v", "s", "en", i)], rollups.CHANGES)
    write, late = one._write, []

    def slow(*args):
        made = write(*args)
        if not late:
            late.append(two.apply("two", change(2)))
        return made

    monkeypatch.setattr(one, "_write", slow)
    assert one.apply("one", change(1)) and late == [True]
    assert one.committed() == ["two", "one"] and tuple(one.totals().first()) == ("s", "en", "v", 2, 3)


def test_counts_of_a_real_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe.default_path())
    reference.no_truncation()
    got = {(r.doc_id, r.version): r.n_tokens for r in rollups.counted(docs_of(spark, ODD).withColumn("version", common.F.lit(1)), "word-bpe-49k", "words-1", "bytes-1").collect()}
    want = {(i, "word-bpe-49k"): len(reference.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    want |= {(i, "bytes-1"): len((t or "").encode()) for i, t in enumerate(ODD)} | {(i, "words-1"): len(brute_words(t)) for i, t in enumerate(ODD)}
    assert got == want


def test_token_counts_where_ids_repeat(spark, tmp_path):
    import duckdb

    rows = [(1, "a b", "en", "s"), (1, "a b c", None, "s"), (1, "a", "en", None), (2, None, None, None), (None, "x", "en", "s"), (3, "bad", "en", "s"), (4, "é", "fr", "t"), (4, "é", "fr", "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = rollups.op10_token_counts(spark, f"file://{tmp_path}").select("source", "lang", "version", "n_docs", "n_tokens").collect()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(rollups.OP10_SQL).fetchall(), key=str)


# Words.
def brute_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]


def test_word_hashes(monkeypatch):
    texts = [*ODD, "Ab " + "Z" * 300 + " " + "z" * 300, "q" * 900 + "\n" + "q" * 901, "end "]
    whole = common.word_hashes(texts)
    monkeypatch.setattr(common, "PIECE", 64)
    hashes, first = common.word_hashes(texts)
    assert np.array_equal(hashes, whole[0]) and np.array_equal(first, whole[1])
    words = [brute_words(t) for t in texts]
    assert np.diff(first).tolist() == list(map(len, words))
    known = {}
    for w, h in zip(sum(words, []), hashes.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) and not len(common.word_hashes([])[0])


def twins(n):
    """Two words whose letters cancel out in every polynomial modulo a power of two."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_confuses(spark):
    a, b = twins(1024)
    got = jaccard.join(docs_of(spark, [f"{a} {a} {a} {a}", f"{b} {b} {b} {b}"])).collect()
    assert {(x.doc_id, x.component_id, x.n_links) for x in got} == {(0, 0, 0), (1, 1, 0)}
    rows = katz.score(docs_of(spark, [a, b, f"{a} {b}"]), common.F.col("doc_id") == 2).collect()
    known = {x.doc_id: x.base_score for x in rows}
    assert known[2] == pytest.approx(2 * np.log10(2 / 8) + np.log10(3 / 8)) and known[0] == pytest.approx(np.log10(2 / 8) + np.log10(3 / 8))


def test_memory_of_long_texts():
    import tracemalloc

    text = "alpha beta gamma " * 400_000
    tracemalloc.start()
    common.word_hashes([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)


# Rows that may have one of some ids.
@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_rows_without_some_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.createDataFrame([(i if i % 11 else None, i, "x") for i in range(300)], "doc_id bigint, slot bigint, word string")
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(None,)], "doc_id bigint")
    left = common.without(rows, ids, "doc_id")
    assert left.columns == rows.columns and {r.slot for r in left.collect()} == {i for i in range(300) if not i % 11 or i % 7}
    some, rest = common.perhaps(rows, ids, "doc_id")
    assert some.count() + rest.count() == 300 and not {r.doc_id for r in rest.collect()} & set(range(0, 300, 7))


# Names that the operators use themselves, empty tables, and texts of some megabytes.
CLASH = "key node other cluster cell cells docs least size root others a b id ids n_tokens t c0 c1 lang_pred score dim pivot dist spans slot word bits value kind columns held bucket version n seq x".split()


def crowded(table):
    return table.select("*", *[common.F.lit("z").alias(c) for c in CLASH if c not in table.columns])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clashing_names_change_nothing(spark):
    r = random.Random(41)
    docs = docs_of(spark, [*ODD, *[prose(r, 40) for _ in range(8)], prose(r, 40) + " secret=abcdefgh1"])
    vectors = spark.createDataFrame([(i, [float(i % 7), 0.5, -0.25 * i]) for i in range(60)], "vec_id bigint, embedding array<float>")
    net = langid.fit(docs)
    for run in (
        lambda d: jaccard.join(d).select("doc_id", "n_shingles", "component_id", "n_links"),
        lambda d: jaccard.deduplicate(d).select("doc_id", "text"),
        lambda d: bpe.encode(d).select("doc_id", "ids_sha256"),
        lambda d: secrets.scan(d).select("doc_id", "spans"),
        lambda d: secrets.redact(d).select("doc_id", "text", "n_chars"),
        lambda d: langid.predict(d, net, ["doc_id"]).select("doc_id", "lang_pred", "score"),
        lambda d: langid.identify(d).select("doc_id", "text"),
        lambda d: katz.score(d, common.F.col("doc_id") == 3).select("doc_id", "n_tokens", "n_known"),
        lambda d: rollups.counted(d, "words-1", "bytes-1"),
    ):
        assert rows_of(run(crowded(docs))) == rows_of(run(docs))
    assert jaccard.deduplicate(crowded(docs)).columns == crowded(docs).columns
    search = lambda v: topk.search(topk.usable(v), common.F.col("vec_id") % 50 == 0)
    assert rows_of(search(crowded(vectors))) == rows_of(search(vectors))


def test_empty_tables(spark):
    none = docs_of(spark, [])
    for df in (bpe.encode(none), secrets.redact(none), jaccard.deduplicate(none), langid.identify(none), katz.score(none, common.F.lit(False))):
        assert df.count() == 0
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_texts_of_megabytes(spark):
    long = " ".join(f"word{i % 5000} {i}" for i in range(150_000))
    docs = docs_of(spark, [long, long + " end", "short text here"])
    assert [(x.doc_id, x.component_id) for x in jaccard.join(docs).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 2)]
    assert {x.doc_id: x.n_tokens for x in katz.score(docs, common.F.col("doc_id") == 1).collect()} == {0: 300_001, 1: 300_002, 2: 4}
    bench = spark.createDataFrame([(0, "word77 5077 word78")], "item_id bigint, text string")
    assert [x.doc_id for x in decontaminate.scan(docs, bench).orderBy("doc_id").collect()] == [0, 1]
    assert one_page(f"<article><p>{long}</p></article>") == long
