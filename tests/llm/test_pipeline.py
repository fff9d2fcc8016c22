"""The five stages against a chain written from their rules, and language ID on held-out documents."""

import hashlib
import random

import pytest
from test_small import DOCS, ODD, brute_components, brute_spans, docs_of, prose

from quarry.llm import bpe, langid
from quarry.llm.common import bucket_of

LETTERS = {"xx": "abcdefgh", "yy": "opqrstuv", "zz": "ijklmnwx"}


def made(r, lang, n):
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randrange(2, 8))) for _ in range(n))


def redacted(text):
    out, end = [], 0
    for start, _, _, stop in brute_spans(text):
        if start >= end:
            out += [text[end:start], "[secret]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(31)
    rows = []
    for i in range(90):
        lang = "xyz"[i % 3] * 2
        rows.append([made(r, lang, r.randrange(20, 120)), lang])
    items = [made(r, "xx", 14), made(r, "yy", 25)]
    rows += [[t, "xx"] for t in ODD]
    rows += [[f"{made(r, 'yy', 30)} {items[0].upper()} {made(r, 'yy', 9)}", "yy"], [f"{made(r, 'xx', 3)} {items[1][:40]}k{items[1][40:]}", None]]
    rows += [[rows[4][0], "yy"], [rows[4][0].replace(" ", "\n", 3).upper(), None], [rows[40][0] + " tail", "yy"], [f"{made(r, 'zz', 25)} token=abc123def456 {'ab12' * 9}", "zz"]]
    table = spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, (t, la) in enumerate(rows)] + [(7, rows[7][0], rows[7][1], "s", 1)], DOCS)
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    kept = {i: t for i, (t, _) in enumerate(rows) if langid.has_letter(t)}
    ids = list(kept)
    component = brute_components(list(kept.values()), 5, 80)
    kept = {i: kept[i] for at, i in enumerate(ids) if component[at][1] == at}
    held = {90 + len(ODD), 91 + len(ODD)}
    assert held <= set(kept) and {92 + len(ODD), 93 + len(ODD)}.isdisjoint(kept)
    kept = {i: redacted(t) for i, t in kept.items() if i not in held}
    assert "[secret]" in kept[95 + len(ODD)]

    reference = tokenizers.Tokenizer.from_file(bpe.default_path())
    reference.no_truncation()
    want = []
    for i, t in kept.items():
        tokens = reference.encode(t, add_special_tokens=False).ids
        want += [(i, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(reference.decode(tokens, skip_special_tokens=False).encode()).hexdigest())] * (1 + (i == 7))
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want)


def test_stages_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs_of(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "some words of an item")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_languages_of_held_out_documents(spark):
    r = random.Random(33)
    rows = [(i, made(r, la, r.randrange(3, 40)), la, "s", 0) for i in range(400) for la in ("xyz"[i % 3] * 2,)]
    table = spark.createDataFrame(rows, DOCS)
    net = langid.fit(table.where(bucket_of("doc_id", 4) != 2))
    told = [(x.lang, x.lang_pred) for x in langid.predict(table.where(bucket_of("doc_id", 4) == 2), net, ["lang"]).collect()]
    assert len(told) > 60 and sum(a == b for a, b in told) >= 0.97 * len(told)


def test_a_language_like_no_other_goes(spark):
    """What the network scores decides: at a floor of certainty even clean documents go, at none only those without letters."""
    r = random.Random(34)
    rows = [(i, made(r, "xyz"[i % 3] * 2, 20), "xyz"[i % 3] * 2, "s", 0) for i in range(120)] + [(500, prose(r, 3), None, "s", 0), (501, "12 34", "xx", "s", 0)]
    table = spark.createDataFrame(rows, DOCS)
    count = lambda least: langid.identify(table, least).count()
    assert count(0.0) == 121 and count(1.0) < count(langid.LEAST_SHARE) <= 121 and langid.identify(table).columns == table.columns
