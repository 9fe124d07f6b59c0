"""Hard negatives, importance resampling and SimHash groups against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rolescope.llm import hard_negatives, importance, simhash
from rolescope.llm.queries import QUERIES

from . import brute

SMALL = "/root/testdata/sf0.001"


# hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    whole = set()
    for vec_id, label, vector in rows:
        if None in (vec_id, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.add((vec_id, label, tuple(math.floor(scale * np.float64(x)) for x in vector)))
    out = []
    for anchor in whole:
        if not is_anchor(anchor[0]):
            continue
        score = lambda row: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(row[2], anchor[2]))))  # noqa: B023, B905, E731
        best = lambda fits: sorted({(-score(r), r[0]) for r in whole if fits(r)})  # noqa: B023, E731
        others = best(lambda r: r[1] != anchor[1])  # noqa: B023
        for down, positive in best(lambda r: r[1] == anchor[1] and r[0] != anchor[0])[:positives]:  # noqa: B023
            window = [(-d, v) for d, v in others if low * -down <= 100 * -d <= high * -down]
            out += [(anchor[0], positive, i + 1, v, -down, s) for i, (s, v) in enumerate(window[:negatives])]
    return sorted(out)


KINDS = "vec_id long, label int, embedding array<float>"


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect()))


def test_negatives_of_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    out = sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, SMALL).collect()))
    assert out and out == plain_negatives(moved, lambda v: v % 100 == 0)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_in_blocks_with_ties(spark, seed):
    pick = random.Random(seed)
    # small whole components make ties, negative scores and zero scores
    rows = [(i, pick.randrange(3), [pick.randrange(-2, 4) / 256 for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    assert mined(df, block=4, negatives=3) == plain_negatives(rows, lambda v: v % 10 == 0, negatives=3)


def test_negatives_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.6, 0.1]),
        (2, 2, [0.6, 0.1]), (3, 2, [0.5]), (4, 2, []), (5, 2, [0.3, 0.4, 9.0]), (6, None, [1.0, 1.0]),
        (None, 2, [0.5, 0.5]), (7, 2, None), (8, 2, [None, 0.5]), (9, 2, [nan, 0.5]), (11, 2, [inf, 0.5]),
        (10, 1, [3e38, 3e38]), (12, 1, [2e38, 3e38]), (13, 3, [1e-3, 0.0]), (20, 7, [0.1, 0.1]), (10, 2, [0.7, 0.2]),
    ]
    df = spark.createDataFrame(rows, KINDS)
    df = df.select("*", F.lit("x").alias("VEC_ID"), F.lit(1).alias("rank"))
    assert mined(df) == plain_negatives(rows, lambda v: v % 10 == 0)
    assert mined(df.where("1 = 0")) == [] and mined(df.where("label = 7")) == []


def test_negatives_keep_a_hot_label_whole(spark):
    pick = random.Random(5)
    rows = [(i, 0 if i % 3 else i % 7, [pick.random() for _ in range(4)]) for i in range(400)]
    assert mined(spark.createDataFrame(rows, KINDS)) == plain_negatives(rows, lambda v: v % 10 == 0)


# importance resampling


def plain_features(text):
    w = (text or "").encode().translate(importance.PLAIN).split()
    return w, [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g) % 10_000
    have = Counter(bucket(g) for _, text in docs for g in plain_features(text)[1])
    want = Counter(bucket(g) for text in target for g in plain_features(text)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((have[b] + 1) * (t + 10_000))))
    out = []
    for doc, text in docs:
        w, grams = plain_features(text)
        weight = sum(gain(bucket(g)) for g in grams)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(grams), weight, score, None, len(w)])
    fit = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], -r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def resampled(docs, target, **options):
    out = importance.resample(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=repr)


def test_resampling_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    out = QUERIES["op12_importance_resampling"](spark, SMALL).collect()
    assert sorted(map(tuple, out), key=repr) == plain_resample(docs, target)


def test_crc_of_any_ngram():
    for text in ("", "One", "Ünï — çode 12_ab", "a " * 100 + "b" * 70_000 + " c " + "x" * 5000 + " tail"):
        w, _ = plain_features(text)
        prefixes = importance.Prefixes([None, text, "other words"])
        for n in (1, 2, 3):
            row, crc = prefixes.ngrams(n)
            assert crc[row == 1].tolist() == [zlib.crc32(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]


def test_resampling_with_odd_rows(spark):
    pick = random.Random(3)
    words = ["data", "Data", "model", "x1", "née", "the", "w" * 3000]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    same = text(40)
    docs = [(i, text(pick.randrange(10, 60))) for i in range(150)] + [(500, same)] * 60
    docs += [(600, None), (601, ""), (602, "--- ???"), (None, text(50)), (None, None), (603, text(20_000))]
    target = [text(30), None, "", "model data"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    df = df.select("*", F.lit("no").alias("Text"), F.lit(0).alias("rank"), F.lit(0).alias("Score"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert resampled(df, goal) == plain_resample(docs, target)
    assert resampled(df, goal, percent=60) == plain_resample(docs, target, percent=60)
    assert resampled(df, goal.where("1 = 0")) == plain_resample(docs, [])
    assert resampled(df.where("1 = 0"), goal) == []


def test_drawn_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ranks = importance.resample(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    drawn = importance.drawn_texts(docs, ranks)
    assert drawn.columns == docs.columns and drawn.count() == ranks.where("rank is not null").count() > 0


# SimHash


def plain_mark(text, size=4):
    w = [x.encode() for x in brute.words(text, fold=True)]
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, most=4):
    """Smallest doc_id reachable, by doc_id, from (doc_id, fingerprint) pairs."""
    by_mark = defaultdict(list)
    for doc, mark in marks:
        by_mark[mark].append(doc)
    root = {m: m for m in by_mark}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(by_mark, 2):
        if (x ^ y).bit_count() <= most:
            root[find(x)] = find(y)
    least = defaultdict(lambda: 1 << 62)
    for m, docs in by_mark.items():
        least[find(m)] = min(least[find(m)], *docs)
    return {doc: least[find(m)] for doc, m in marks}


def test_simhash_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    marks = [(d, plain_mark(t)) for d, t in docs]
    groups = plain_components(marks)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash"](spark, SMALL).collect()}
    assert out == {d: (f"{m:016x}", groups[d]) for d, m in marks}


def test_hashes_are_spark_s_own(spark):
    text = "The quick brown fox; jumps\tover ÉÈ the lazy dog"
    mine = simhash.shingle_hashes(text, 4, 42)
    w = brute.words(text, fold=True)
    rows = spark.createDataFrame([(i, " ".join(w[i : i + 4])) for i in range(len(w) - 3)], "i int, g string")
    assert mine.view(np.int64).tolist() == [r[0] for r in rows.orderBy("i").select(F.xxhash64("g")).collect()]


def test_walsh_distances():
    marks = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes = [sum(((r & k).bit_count() & 1) << k for k in range(64)) for r in range(64)]
    expected = [[(int(m) ^ code).bit_count() for m in marks] for code in codes]
    tables = simhash.distance_tables(marks)
    assert tables.tolist() == expected
    apart = ((tables[:, :, None].astype(int) - tables[:, None, :]) ** 2).sum(axis=0)
    assert apart.tolist() == [[64 * (int(x) ^ int(y)).bit_count() for y in marks] for x in marks]


def test_three_blocks_always_agree():
    masks = simhash.block_masks(4)
    pick = random.Random(2)
    assert len(masks) == 35
    for _ in range(500):
        flips = sum(1 << b for b in pick.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def near_marks(seed, n):
    """Chains and crowds of fingerprints a few bits apart."""
    pick, out = random.Random(seed), []
    for _ in range(6):
        m = pick.getrandbits(64)
        for _ in range(n):
            out.append(m ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(4))))
            if pick.random() < 0.1:
                m = out[-1] ^ sum(1 << b for b in pick.sample(range(64), 3))
    return out


@pytest.mark.parametrize("limit", [4096, 8])
def test_simhash_groups_of_crowds(spark, monkeypatch, limit):
    marks = list(enumerate(near_marks(limit, 60)))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    df = spark.createDataFrame([(d, signed(m)) for d, m in marks], "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size, seed: docs)
    monkeypatch.setattr(simhash, "PAIRS", 1000)
    out = {r.doc_id: r.component_id for r in simhash.link_groups(df, limit=limit).collect()}
    assert out == plain_components(marks) and len(set(out.values())) > 6


def test_simhash_with_odd_rows(spark):
    long = " ".join(f"w{i % 70}" for i in range(60_000))
    rows = [
        (3, "Alpha beta"), (1, "alpha  BETA"), (3, "Alpha beta"), (2, "alpha beta gamma delta"), (None, "alpha beta"),
        (5, None), (4, ""), (6, " \n\t"), (None, None), (7, long), (8, long + " tail"), (9, "one"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", F.lit(1).alias("Text"), F.lit("f").alias("fingerprint"), F.lit(0).alias("Component_ID"))
    groups = plain_components([(d, plain_mark(t)) for d, t in rows if d is not None])
    expected = [(d, f"{plain_mark(t):016x}", groups.get(d)) for d, t in rows]
    assert sorted(map(tuple, simhash.link_groups(df).collect()), key=repr) == sorted(expected, key=repr)
    assert simhash.link_groups(df.where("1 = 0")).collect() == []
