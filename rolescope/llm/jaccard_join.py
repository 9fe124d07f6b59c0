"""Links documents whose sets of word shingles are alike, and finds the groups that links make.

Two documents are linked when ``100 * intersection >= percent * union`` of their sets.

1. Equal sets are one class; its smallest doc_id stands for it.
2. Shingles are put in one order for all documents: shingles known to be frequent last, by
   frequency, the rest by hash. In that order, linked documents share a shingle among the
   first n - ceil(t n) + 1 of each (the prefix); and m shingles among the first
   n - ceil(t n) + m (a multi-match prefix). A document takes the m for which its prefix, the
   meetings with documents of its size (the sum of frequencies over the part they need) and the
   candidates estimated to come of them (that sum divided by m) cost least; frequent shingles in a prefix make m
   large. A pair must share as many as the smaller m of the two says.
   Both sizes known, the overlap that a link needs is known too, and cuts the prefixes of a
   pair further; the smaller document of any pair needs about half its prefix.
3. Documents that share a rare prefix shingle are compared in pairs. The users of a frequent
   one are first compared with one of them only. Only pairs that the links found so far do
   not already hold together are then looked at, all of them.
4. Candidates are verified on whole sets; groups are the connected components.

Frequencies only choose the order and m, so the links found are the same with any of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import stored

#: Frequent shingles that are told apart in the order; a fixed number, it bounds what is sent to tasks.
ORDERED = 1 << 18
#: Text that a task works on at a time.
BATCH_BYTES = 2 << 20
#: Multi-matches that are weighed for a document; users of a shingle up to which all of its pairs are candidates at once.
MOST_MATCHES, FEW = 255, 8
#: What comparing two whole sets costs, in meetings of two documents under a shingle. It chooses m only.
COMPARISON = 4


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows in order of row, then hash; and where rows begin.

    A text of fewer words than ``size`` has one shingle, all its words.
    """
    w = W.words(column, fold=True)
    at, hashes = w.windows(size)
    row = w.row[at]
    short = np.flatnonzero((w.counts() < size) & (w.counts() > 0))
    if len(short):
        whole = W.spans_hash(w.hash, w.first[short], w.first[short + 1])
        hashes = np.concatenate([hashes, W.mix(whole + w.counts()[short].astype(np.uint64))])
        row = np.concatenate([row, short.astype(np.int32)])
    rows = len(w.first) - 1
    order = np.argsort(hashes)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 1 << 16 else np.uint32), kind="stable")]
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def _facts(docs: DataFrame, size: int, often: int = 2) -> DataFrame:
    """A row per document (n_shingles, signature of the set) and per shingle common within a batch (times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.batches(batches, most=BATCH_BYTES):
            hashes, first = shingles(table["text"], size)
            signs = [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
            ranked = np.sort(hashes)
            starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(ranked)))
            common = starts[times >= often]
            n, k = table.num_rows, len(common)
            yield from pa.table(
                {
                    "doc_id": pa.concat_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), pa.nulls(k, pa.int64())]),
                    "n_shingles": pa.concat_arrays([pa.array(np.diff(first), pa.int64()), pa.nulls(k, pa.int64())]),
                    "sign": pa.concat_arrays([pa.array(signs, pa.binary()), pa.nulls(k, pa.binary())]),
                    "shingle": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ranked[common].view(np.int64))]),
                    "times": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times[times >= often], pa.int64())]),
                }
            ).to_batches()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, sign binary, shingle long, times long"
    )


def _prefixes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray, times: np.ndarray) -> DataFrame:
    """doc_id, n, m, prefix: the first shingles of each document, as many as its m asks for."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = sent.value
        for table in W.batches(batches, most=BATCH_BYTES):
            hashes, first = shingles(table["text"], size)
            cost = np.ones(len(hashes))
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                cost = np.where(frequent[at] == hashes, times[at], 1)
            matches, chosen = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                n = int(b - a)
                base = n - (percent * n + 99) // 100 + 1
                h, c = hashes[a:b], cost[a:b]
                cold = c == 1
                if cold.sum() >= min(n, base + MOST_MATCHES - 1):
                    h, c = h[cold], c[cold]
                else:
                    order = np.lexsort((h, c))
                    h, c = h[order], c[order]
                # rows of the index; users of the part that a partner of the same size needs are met, and
                # compared the less the more matches they need
                sizes = np.arange(base, min(n, base + MOST_MATCHES - 1) + 1)
                m = sizes - base + 1
                alike = n - (2 * percent * n + 99 + percent) // (100 + percent)
                met = np.cumsum(c)[alike + m - 1] if n else np.zeros(0)
                spent = sizes + met * (1 + COMPARISON / m)
                m = int(np.argmin(spent)) + 1 if n else 0
                chosen.append(h[: base + m - 1] if n else h)
                matches.append(m)
            ends = np.cumsum([0, *map(len, chosen)])
            yield from pa.table(
                {
                    "doc_id": table["doc_id"].combine_chunks().cast(pa.int64()),
                    "n": pa.array(np.diff(first), pa.int64()),
                    "m": pa.array(matches, pa.int32()),
                    "prefix": pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.concatenate(chosen).view(np.int64))
                    ),
                }
            ).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, m int, prefix array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.batches(batches, most=BATCH_BYTES):
            hashes, first = shingles(table["text"], size)
            packed = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield from pa.table({"doc": table["doc_id"], "hashes": pa.array(packed, pa.binary())}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets are alike."""
    both = pairs.join(sets.select(F.col("doc").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    both = both.join(sets.select(F.col("doc").alias("a"), F.col("hashes").alias("hashes_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _packed(n, m, i):
    """Set size, multi-match and place of a prefix shingle in one number: rows of uses are many."""
    return F.shiftleft(n, 36) + F.shiftleft(m.cast("long"), 28) + i


def _size(use):
    return F.shiftright(use["info"], 36)


def _matches(use):
    return F.shiftright(use["info"], 28).bitwiseAND(F.lit(255).cast("long"))


def _place(use):
    return use["info"].bitwiseAND(F.lit((1 << 28) - 1).cast("long"))


def _pair(x, y):
    """a < b with the matches they need, from two uses of a shingle."""
    first = x["doc"] < y["doc"]
    return F.struct(
        F.when(first, x["doc"]).otherwise(y["doc"]).alias("a"),
        F.when(first, y["doc"]).otherwise(x["doc"]).alias("b"),
        F.least(_matches(x), _matches(y)).alias("need"),
    )


def _may_link(x, y, percent: int):
    """The shingle lies in the prefix of both that their sizes and common m ask for.

    Linked sets share o = ceil(t (n + n') / (1 + t)) shingles or more, so the m-th one they share is among
    the first n - o + m of either.
    """
    overlap = F.floor((percent * (_size(x) + _size(y)) + 99 + percent) / (100 + percent))
    need = F.least(_matches(x), _matches(y)) - overlap
    sizes = 100 * F.least(_size(x), _size(y)) >= percent * F.greatest(_size(x), _size(y))
    return sizes & (_place(x) < _size(x) + need) & (_place(y) < _size(y) + need) & (x["doc"] != y["doc"])


def _serves_smaller(use, percent: int):
    """Whether the shingle lies in the prefix that the smaller document of a pair needs."""
    overlap = F.floor((2 * percent * _size(use) + 99 + percent) / (100 + percent))
    return _place(use) < _size(use) - overlap + _matches(use)


def _larger(x, y):
    """Pairs once each: x has the larger set, or the larger doc_id of equal sizes."""
    return (_size(x) > _size(y)) | ((_size(x) == _size(y)) & (x["doc"] > y["doc"]))


def link_groups(docs: DataFrame, percent: int = 90, size: int = 3, few: int = FEW) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id.

    ``component_id`` is the smallest doc_id that links reach, the document's own included.
    Words have A-Z lower-cased; a null or empty text has an empty set and no links. A row
    with a null doc_id has no component and links nothing; repeated rows share their set's
    class. Shingles are compared by 64-bit hashes. Columns beside doc_id and text are ignored.
    """
    facts = stored(_facts(docs, size), "jaccard-facts")
    common = facts.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    common = common.orderBy(F.desc("times"), "shingle").limit(ORDERED).toArrow()
    keys = np.asarray(common["shingle"]).astype(np.int64).view(np.uint64)
    times = np.asarray(common["times"]).astype(np.float64)
    order = np.argsort(keys)

    rows = facts.where("sign is not null").select("doc_id", "n_shingles", "sign")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("n_shingles", "sign").agg(F.min("doc_id").alias("doc")), "jaccard-classes")

    prefixes = _prefixes(docs, size, percent, keys[order], times[order])
    prefixes = prefixes.join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    prefixes = stored(prefixes, "jaccard-prefixes")
    uses = prefixes.select("doc_id", "n", "m", F.posexplode("prefix").alias("i", "shingle"))
    uses = uses.select("shingle", F.col("doc_id").alias("doc"), _packed(F.col("n"), F.col("m"), F.col("i")).alias("info"))
    shared = uses.groupBy("shingle").agg(F.count("*").alias("users"), F.min(F.struct("doc", "info")).alias("lead")).where("users > 1")
    uses = stored(uses.join(shared, "shingle"), "jaccard-uses")

    rare, frequent = uses.where(F.col("users") <= few), uses.where(F.col("users") > few)
    lists = rare.groupBy("shingle").agg(F.collect_list(F.struct("doc", "info")).alias("l"))  # at most ``few`` entries
    found = F.flatten(
        F.transform(
            "l",
            lambda x, i: F.transform(
                F.filter(F.slice("l", i + 2, F.lit(few)), lambda y: _may_link(x, y, percent)), lambda y: _pair(x, y)
            ),
        )
    )
    near = lists.select(F.explode(found).alias("p")).select("p.*").groupBy("a", "b", "need").agg(F.count("*").alias("n"))
    near = stored(near, "jaccard-near")
    # a guess that spares most comparisons in large groups; what it misses is looked at below
    led = frequent.where(_may_link(F.col("lead"), {"doc": F.col("doc"), "info": F.col("info")}, percent))
    led = led.select(_pair(F.col("lead"), {"doc": F.col("doc"), "info": F.col("info")}).alias("p")).select("p.*")
    led = led.groupBy("a", "b", "need").agg(F.count("*").alias("n")).where("2 * n >= need").select("a", "b", "n")
    first = near.where("n >= need").select("a", "b", "n").union(led)
    first = first.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    first = stored(first, "jaccard-first")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = stored(ids.distinct(), "jaccard-ids")  # of a known size, so that texts are shuffled only for many
        return stored(_sets(docs.join(ids, "doc_id", "left_semi"), size), "jaccard-sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select("b").distinct())

    sets = texts_of(ends(near.where("n >= need").select("a", "b").union(first)))
    links = stored(_verified(first, sets, percent), "jaccard-links")
    groups = components(links)

    # what the first links leave open: pairs of different groups, all of them
    def grouped(df: DataFrame, key: str, name: str) -> DataFrame:
        named = groups.select(F.col("node").alias(key), F.col("component").alias(name))
        return df.join(named, key, "left").withColumn(name, F.coalesce(name, key))

    apart = grouped(grouped(near, "a", "ga"), "b", "gb").where("ga <> gb").select("a", "b", "need", "n")
    mixed = grouped(frequent.select("shingle", "doc", "info"), "doc", "g")
    several = mixed.groupBy("shingle").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least < most")
    mixed = mixed.join(several.select("shingle"), "shingle", "left_semi")
    mixed = mixed.select("shingle", F.struct("doc", "info").alias("use"), "g")
    x, y = mixed.alias("x"), mixed.where(_serves_smaller(F.col("use"), percent)).alias("y")
    far = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.g") != F.col("y.g")))
    far = far.where(_larger(F.col("x.use"), F.col("y.use")) & _may_link(F.col("x.use"), F.col("y.use"), percent))
    far = far.select(_pair(F.col("x.use"), F.col("y.use")).alias("p")).select("p.*")
    far = far.groupBy("a", "b", "need").agg(F.count("*").alias("n"))
    rest = apart.union(far).groupBy("a", "b", "need").agg(F.sum("n").alias("n")).where("n >= need").select("a", "b")
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "jaccard-rest")
    more = ends(rest).distinct()
    more = more.join(sets.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti")
    if not more.isEmpty():
        sets = sets.union(texts_of(more))
    if not rest.isEmpty():
        groups = components(links.union(stored(_verified(rest, sets, percent), "jaccard-links")))

    named = classes.join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("n_shingles", "sign", F.coalesce("component", "doc").alias("component"))
    out = rows.join(named, ["n_shingles", "sign"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
