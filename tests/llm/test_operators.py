"""Each operator against its plain version, and on nulls, empties, long texts, copies and odd columns."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from rolescope.llm import (
    byte_bpe,
    components,
    decontaminate,
    elias_fano,
    jaccard_join,
    line_dedup,
    ngram_lm,
    quality,
    secrets,
    substring,
    toxicity,
    url_filter,
)
from rolescope.llm import words as W

from . import brute

SMALL = "/root/testdata/sf0.001"
ODD = [
    (None, "a text without an id " * 6),
    (900_001, None),
    (900_002, ""),
    (900_003, " \t\n\r "),
    (900_004, "one"),
    (900_005, "same text twice over and over again " * 5),
    (900_006, "same text twice over and over again " * 5),
    (900_007, " ".join(f"w{i % 977}" for i in range(30_000))),
    (900_008, "tab\tand\x0bother\x0cspace\nÄÖ ÉÑ naïve 日本語 🙂 ..."),
    (900_009, "x" * 5000),
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The small documents and odd ones, with columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({"block": F.lit("x"), "n": F.lit(None).cast("int"), "score": F.lit(1), "dropped": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_row(df, *cols):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


# ------------------------------------------------------------------ words


def test_words_and_windows(rows):
    texts = [t for _, t in rows]
    w = W.words(pa.array(texts, pa.string()), fold=True)
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first, w.first[1:], strict=False)]
    assert got == [brute.words(t, fold=True) for t in texts]
    at, hashes = w.windows(4)
    plain = [tuple(x[i : i + 4]) for x in got for i in range(len(x) - 3)]
    assert len(at) == len(plain)
    assert len(set(hashes.tolist())) == len(set(plain))
    assert len(set(zip(hashes.tolist(), plain, strict=True))) == len(set(plain))


@pytest.mark.parametrize("universe, n", [(10, 5), (1000, 400), (10**9, 5000), (50, 50), (10**13, 3000), (7, 0)])
def test_elias_fano(universe, n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n))
    coded = elias_fano.EliasFano(*elias_fano.encode(values, universe), len(values))
    assert (coded[np.arange(len(values))] == values).all()
    asked = rng.integers(0, universe, 500)
    there = np.searchsorted(values, asked)
    assert (coded.find(asked) == np.where(np.isin(asked, values), there, -1)).all()


# ------------------------------------------------------------------ line dedup


def test_lines_recurring_in_enough_texts_are_dropped(spark):
    line = "this site uses cookies from 3 partners and keeps them for many days please accept all of them"
    other = line.replace("3 partners", "77 partners").replace("many", "few")
    data = [(i, f"own line number {chr(97 + i)} here\n{line if i % 2 else other}\nend") for i in range(6)]
    data += [(10, "only line that two share in the table"), (11, "only line that two share in the table\nx y z q")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.drop_recurring(df).collect()}
    assert out[0].text == data[0][1] and out[0].dropped == []
    for i in range(1, 6):
        assert out[i].dropped == [1] and out[i].text == f"own line number {chr(97 + i)} here\nend"
    assert out[10].dropped == [] and out[11].dropped == []


def test_copies_of_one_text_are_no_boilerplate(spark):
    df = spark.createDataFrame([(i, "a whole text that has many exact copies") for i in range(9)], "doc_id long, text string")
    assert line_dedup.drop_recurring(df).where("size(dropped) > 0").isEmpty()


def test_line_dedup_keeps_rows_and_columns(docs, rows, empty):
    out = line_dedup.drop_recurring(docs)
    assert out.columns == ["doc_id", "text", "block", "n", "score", "n_lines", "dropped"]
    texts = {d: t for d, t in rows}
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        lines = texts[r.doc_id].split("\n") if texts[r.doc_id] is not None else None
        kept = None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in r.dropped)
        assert r.text == kept
    assert line_dedup.drop_recurring(empty).count() == 0


# ------------------------------------------------------------------ quality


def test_quality_measures(docs, rows, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = by_row(quality.judge(docs), "doc_id", *names)
    expected = sorted(((d, *brute.measures(t)) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected
    assert quality.judge(empty).count() == 0


def test_quality_rules_are_named(spark):
    noise = " ".join(["#$% word"] * 60)
    prose = " ".join(f"the {a}{b}x of" for a in "abcdefgh" for b in "abcdefgh")
    df = spark.createDataFrame([(1, prose), (2, noise), (3, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert out[1].kept and out[1].failed == []
    assert not out[2].kept and out[2].base_failed
    assert not out[3].kept and out[3].base_failed


# ------------------------------------------------------------------ toxicity


def plain_marginals(scores, change):
    """P(toxic) of each word of one chain by summing over all labellings."""
    total, toxic = 0.0, np.zeros(len(scores))
    for labelling in range(1 << len(scores)):
        y = [(labelling >> t) & 1 for t in range(len(scores))]
        weight = np.exp(sum(s for s, k in zip(scores, y, strict=True) if k) + sum(change[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += weight
        toxic += weight * np.array(y)
    return toxic / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    change = rng.normal(size=(2, 2))
    scores = rng.normal(size=15)
    start, length = np.array([0, 6, 7]), np.array([6, 1, 8])
    got, pairs = toxicity._marginals(scores, start, length, change)
    expected = np.concatenate([plain_marginals(scores[a : a + n], change) for a, n in zip(start, length, strict=True)])
    assert np.allclose(got, expected)
    assert np.isclose(pairs.sum(), (length - 1).sum())


def test_toxicity_learns_and_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    field = toxicity.train(docs, labels, fold != 2, most_docs=1500)
    judged = toxicity.score(docs.where(fold == 2), field).join(labels, "doc_id")
    counts = {(r.toxic, r.p): r["count"] for r in judged.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).count().collect()}
    hit, missed = counts.get((1, True), 0), counts.get((1, False), 0)
    false = counts.get((0, True), 0)
    assert hit >= 0.9 * (hit + missed)
    assert false <= 0.02 * (false + counts[(0, False)])


def test_toxicity_spans_and_odd_rows(spark, docs, rows, empty):
    bad = "you are an Ñ wretchx fool"
    texts = [bad + f" {i}" for i in range(12)] + [f"quite a pleasant day number {i}" for i in range(12)]
    field = toxicity.fit(texts, [1] * 12 + [0] * 12)
    df = spark.createDataFrame([(1, "Ñandú: wretchx!"), (2, "quite a day"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score(df, field).collect()}
    assert out[1].score > 0.5 and [("Ñandú: wretchx!")[s.start : s.end] for s in out[1].spans][-1].endswith("wretchx")
    assert out[3].score == 0 and out[3].spans == []
    assert {r.doc_id for r in toxicity.keep_clean(df, field, 0.5).collect()} == {2, 3}
    scored = toxicity.score(docs, field)
    assert scored.count() == len(rows) and scored.where("score < 0 or score > 1 or score is null").isEmpty()
    assert toxicity.keep_clean(docs, field, 2.0).columns == docs.columns
    assert toxicity.score(empty, field).count() == 0
    none = toxicity.fit([], [])
    assert toxicity.score(df, none).where("score > 0.5").isEmpty()


# ------------------------------------------------------------------ decontamination


def test_alignment():
    rng = random.Random(3)
    for _ in range(40):
        item = [rng.randrange(12) for _ in range(rng.randrange(1, 15))]
        passage = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        score, start, end = decontaminate.align(np.array(passage), np.array(item))
        assert score == brute.best_alignment(passage, item)
        assert score == brute.best_alignment(passage[start:end], item)


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(6)]
    data = []
    for i, text in items:
        w = text.split()
        for edits in (0, 4, 8):
            c = list(w)
            for k in rng.sample(range(40), edits):
                c[k] = rng.choice(vocabulary)
            around = [rng.choices(vocabulary, k=60) for _ in range(2)]
            data.append((100 * i + edits, " ".join([*around[0], *c, *around[1]]).upper()))
    data += [(5000 + i, " ".join(rng.choices(vocabulary, k=300))) for i in range(60)] + ODD
    df = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (77, None), (None, "x y z"), (78, ""), (79, "v1 v2")], "item_id long, text string")
    for block_words in (1 << 18, 30):
        found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, bench, block_words=block_words).collect()}
        assert set(found) == {(100 * i + e, i) for i in range(6) for e in (0, 4, 8)}
        assert found[(0, 0)].score == 1.0 and (found[(0, 0)].start, found[(0, 0)].end) == (60, 100)
    kept = decontaminate.decontaminate(df, bench)
    assert kept.count() == 60 + len(ODD)
    assert decontaminate.matches(df, bench.limit(0)).count() == 0
    assert decontaminate.matches(df.limit(0), bench).count() == 0


# ------------------------------------------------------------------ similarity join


def test_groups_of_small_tables(docs, rows, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(docs).collect()}
    expected = brute.groups(rows)
    assert {d: x for d, x in got.items() if d is not None} == expected
    assert got[None][1] is None
    assert jaccard_join.link_groups(empty).count() == 0


def test_groups_of_edited_copies(spark):
    rng = random.Random(1)
    base = [[f"b{k}w{rng.randrange(300)}" for _ in range(rng.randrange(60, 160))] for k in range(4)]
    data = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(6)}"
        data.append((i, " ".join(w)))
    data += [(300 + i, "the same few words " * 3 + f"tail {i} {i} {i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    expected = brute.groups(data)
    for few in (8, 2):
        out = jaccard_join.link_groups(df, few=few).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    out = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in out.collect()} == {x: find(x) for x in linked}


# ------------------------------------------------------------------ URLs

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://a.net/", "HTTP://A.NET/x?y#z", "https://example.net/en/1",
    "https://m.example.net/en", "https://Example.COM/de/?q=/", "ftp://x.example.com/fr/", "http://org/fr/",
    "http://my.org/fr/x://y/", "http://a.net?x=/", "http://anet/", "http://ex#net/", "http://ünï.org/fr/ä",
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("ünï.org/", "block")]


@pytest.mark.parametrize("array_rules", [1 << 20, 2])
def test_urls(spark, array_rules):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, rule int")
    rules = spark.createDataFrame([*RULES, ("net/", "allow"), (None, "block")], "rule string, verdict string")
    out = url_filter.judge(pages, rules, array_rules=array_rules).collect()
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out if r.rule) + sorted(
        (r.page_id, r.host, r.path, r.verdict) for r in out if not r.rule
    )
    plain = [(i, *brute.url_parts(u), *brute.url_verdict(u, RULES)) for i, u in enumerate(URLS * 2)]
    assert got == sorted(p for p in plain if p[3]) + sorted((*p[:3], p[4]) for p in plain if not p[3])
    assert url_filter.judge(pages, rules.limit(0)).where("verdict <> 'allow'").isEmpty()
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_digests_that_collide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw, seed: len(raw))
    file = tmp_path / "rules.bin"
    file.write_bytes(url_filter.DigestArray.pack([("ab/", True), ("cd/", False), ("x/", True)]))
    array = url_filter.DigestArray(file)
    found = array.find([b"cd/", b"ab/", b"zz/", b"x/", b"long"])
    assert [None if i < 0 else bool(array.block[i]) for i in found] == [False, True, None, True, None]


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_pieces_folded_for_all_batches(spark, ranks):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé \0ß", k=rng.randrange(2, 14))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "4")
    try:
        for most in (byte_bpe.FREQUENT, 40, 0):
            out = byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, most).collect()
            assert {r.doc_id: r.ids for r in out} == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}
        table = byte_bpe.PairTable(byte_bpe.pair_ranks(ranks))
        batches = byte_bpe.split(df, ranks, public_tokenizers.PATTERN)
        held = [len(byte_bpe.fold_frequent(batches, table, m).hashes) for m in (1000, 40, 0)]
        assert held[0] > 40 >= held[1] >= held[2] == 0
    finally:
        spark.conf.set(rows, before)


def test_bpe_is_tiktoken(spark, docs, rows, ranks, empty):
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = rows + [(950_000, "it's we'll  \n\n  x<|endoftext|> ０１２ ½ ！？" + "!?" * 200), (950_001, "thequick" * 90)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = by_row(byte_bpe.decode(byte_bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks), "doc_id", "ids", "bytes")
    data = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in out] == [d for d, _ in data]
    for (_, ids, raw), (_, text) in zip(out, data, strict=True):
        assert ids == tokenizer.encode_ordinary(text or "") and bytes(raw) == (text or "").encode()
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ language model


def test_language_model(docs, rows, empty):
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    import zlib

    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = brute.language_model(order, train, 300.0)
    for sizes in ({}, {"block_bytes": 60_000, "part_tokens": 3_000}):
        got = by_row(ngram_lm.score(docs, learn, **sizes), "doc_id", *names)
        for (doc, *mine), plain in zip(got, expected, strict=True):
            assert tuple(mine[:3]) == plain[:3], doc
            assert mine[3] == pytest.approx(plain[3], rel=1e-9)
            # quantised: half a step a token at most
            assert abs(mine[4] - plain[4]) <= plain[0] * ngram_lm.STEP / 2 + 1e-6
    assert ngram_lm.score(empty, learn).count() == 0
    none = ngram_lm.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_language_model_helps_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    out = ngram_lm.score(df, fold != 0).where(fold == 0).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# ------------------------------------------------------------------ substring dedup


def test_repeated_passages(docs, rows, empty):
    expected = brute.removed(rows)
    for sizes in ({}, {"block_bytes": 50_000, "range_hashes": 3_000}):
        out = substring.spans(docs, **sizes)
        got = by_row(out, "doc_id", "n_words", "n_removed", "text")
        assert got == sorted(expected, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))
        assert out.where("n_removed <> aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").isEmpty()
    assert substring.spans(empty).count() == 0


# ------------------------------------------------------------------ secrets


def test_secrets(spark, docs, rows, empty):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    data = [(i, f'some words token = "{hexes(40)}" more words') for i in range(60)]
    data += [(100 + i, f"in commit {hexes(40)} the word") for i in range(60)]
    data += [(200 + i, f"card {rng.randrange(10**15, 10**16)} paid") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labelled = secrets.known_forms(secrets.findings(df.where("doc_id % 2 = 0")))
    out = secrets.scan(df, labelled).where("doc_id % 2 = 1").collect()
    assert len(out) == 90
    assert all(r.secret == (r.doc_id < 100) for r in out)
    assert secrets.scan(docs, labelled).where("probability is null").isEmpty()
    assert secrets.scan(empty, labelled).count() == 0
    unlabelled = secrets.scan(df, labelled.limit(0)).collect()
    assert len(unlabelled) == 180 and all(r.secret and r.probability == 1 for r in unlabelled)


def test_findings(spark):
    df = spark.createDataFrame([(1, 'a password=abc123def456ghi789 b "x/y/0123456789abcdef01.png" c'), (2, None)], "doc_id long, text string")
    got = [(r.place, r.candidate, r.before.strip(), r.after.strip()) for r in secrets.findings(df).orderBy("place").collect()]
    assert got == [(1, "abc123def456ghi789", "a password=", "b"), (3, "x/y/0123456789abcdef01", 'password=abc123def456ghi789 b "', '.png" c')]
