"""SimHash near-duplicates: fingerprints that differ in a few bits, found with pivot distance tables.

A fingerprint's bit is 1 where more than half of the document's shingle hashes have it set.

1. Equal fingerprints are one class; its smallest doc_id stands for it.
2. The 64 bits are cut into ``most + 3`` blocks. Fingerprints that differ in ``most`` bits
   agree on three blocks at least, so for every three blocks those that agree there meet in
   a bucket. Buckets are found by one shuffle of (key, fingerprint, doc_id).
3. The members of a bucket get a row each in a table of Hamming distances to 64 reference
   fingerprints. Two distances to one reference differ by no more than the fingerprints do,
   so a pair is discarded at the first reference where they differ by more than ``most``.
   The references are the Walsh codes. Their squared distance differences add up to 64 times
   the pair's distance: of pairs that differ in more than ``most ** 2`` bits none is left.
   Survivors are verified.
4. A bucket hands on a link from each member to the first one of its group, not all pairs.
   Groups of documents are the connected components of these links.

A bucket of more than ``limit`` members is cut into parts. Each part first meets only the
first part; where its members then still belong to several groups, those outside the largest
group meet every part. So all pairs of different groups have met, and a large group of near
copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .columns import pick
from .components import components
from .store import stored

#: Members of a bucket part; pairs looked at in one step.
LIMIT, PAIRS = 4096, 1 << 20
FOLD = bytes(W.FOLD.tolist())


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words; of the whole sequence where words are fewer."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[: max(0, len(words) - size)] + 1).tolist()]
    plain, digest = b" ".join(words), xxhash.xxh64_intdigest
    spans = zip(begins, ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(plain[a:b], seed) for a, b in spans), np.uint64, len(begins))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set; zero without hashes."""
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        raw = hashes[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (64 bits as a long): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.batches(batches):
            marks = [fingerprint(shingle_hashes(text, size, seed)) for text in table["text"].to_pylist()]
            marks = pa.array(np.array(marks, dtype=np.uint64).view(np.int64))
            yield from pa.table([table["doc_id"], marks], names=["doc_id", "fingerprint"]).to_batches()

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def block_masks(most: int) -> list[int]:
    """The bits of every three of ``most + 3`` blocks."""
    edges = [64 * i // (most + 3) for i in range(most + 4)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y | z for x, y, z in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance_tables(marks: np.ndarray) -> np.ndarray:
    """A row per reference: the Hamming distances of all fingerprints to that Walsh code."""
    bits = np.unpackbits(marks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    signs = 1 - 2 * bits.astype(np.int8)
    step = 1
    while step < 64:  # the fast Walsh-Hadamard transform
        signs = signs.reshape(-1, 64 // (2 * step), 2, step).astype(np.int16)
        signs = np.stack([signs[:, :, 0] + signs[:, :, 1], signs[:, :, 0] - signs[:, :, 1]], axis=2)
        step *= 2
    return np.ascontiguousarray(((64 - signs.reshape(-1, 64)) // 2).astype(np.int16).T)


def near_pairs(x: np.ndarray, y: np.ndarray, marks: np.ndarray, tables: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs (x, y) are near: those that no reference tells apart, verified."""
    left = np.arange(len(x))
    for table in tables:
        left = left[np.abs(table[x[left]] - table[y[left]]) <= most]
        if len(left) < len(x) >> 6:
            break  # comparing the fingerprints themselves now costs less than a reference
    return left[np.bitwise_count(marks[x[left]] ^ marks[y[left]]) <= most]


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _united(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``parent`` (each member's first one of its group) with the groups of x and y made one."""
    while len(x):
        a, b = parent[x], parent[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _root(parent)
    return parent


def groups_within(marks: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """For members of runs (a bucket each, from ``begins``): the first one that links within the run reach."""
    n = len(marks)
    sizes = np.diff(np.append(begins, n))
    end, first = np.repeat(begins + sizes, sizes), np.repeat(begins, sizes)
    parent, tables = np.arange(n), distance_tables(marks)

    def unite(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal parent
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
        near = near_pairs(x, y, marks, tables, most)
        parent = _united(parent, x[near], y[near])

    unite(first, np.arange(n))  # large groups of near copies come together here
    later = end - np.arange(n) - 1
    upto = np.cumsum(later)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        at = np.arange(a, b)
        unite(np.repeat(at, later[a:b]), W.runs(at + 1, later[a:b]))
        a = b
    return parent


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole buckets of sorted rows, several at a time: fingerprints, doc_ids, where buckets begin."""
    names, held = ("key", "part", "fingerprint", "doc"), None
    for batch in batches:
        rows = [np.asarray(batch[c], dtype=np.int64) for c in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        begins = np.flatnonzero(new)
        cut = begins[-1]  # the last bucket may go on in the next batch
        held = [x[cut:] for x in rows]
        if cut:
            yield rows[2][:cut], rows[3][:cut], begins[:-1]
    if held is not None:
        yield held[2], held[3], np.zeros(1, dtype=np.int64)


def _linked(members: DataFrame, most: int) -> DataFrame:
    """Links (a, b) between documents of a bucket: each member and the first of its group there.

    ``members``: key, part (the bucket), fingerprint, doc.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, docs, begins in _runs_of(batches):
            sizes = np.diff(np.append(begins, len(docs)))
            several = np.repeat(sizes > 1, sizes)
            marks, docs, sizes = marks[several].view(np.uint64), docs[several], sizes[sizes > 1]
            if len(docs):
                parent = groups_within(marks, np.cumsum(sizes) - sizes, most)
                tied = np.flatnonzero(parent != np.arange(len(docs)))
                links = [pa.array(docs[parent[tied]]), pa.array(docs[tied])]
                yield pa.RecordBatch.from_arrays(links, ["a", "b"])

    dealt = members.select("key", "part", "fingerprint", "doc").repartition("key", "part")
    return dealt.sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long").where("a <> b")


def _part_of(parts: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("fingerprint", F.lit(salt)), parts)


def _all_parts(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def link_groups(docs: DataFrame, most: int = 4, size: int = 4, seed: int = 42, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per document.

    Words have A-Z folded; hashes are XXH64 of ``size`` words joined by blanks. Documents link
    when their fingerprints differ in ``most`` bits or fewer; ``component_id`` is the smallest
    doc_id that links reach, the document's own included. A null or empty text has fingerprint
    zero and links like any other. A row with a null doc_id has no component and links nothing;
    repeated rows belong to one class. Other columns are ignored, whatever their names.
    """
    rows = stored(fingerprints(docs, size, seed), "simhash-fingerprints")
    classes = rows.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc"))
    classes = stored(classes, "simhash-classes")
    keys = [F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(block_masks(most))]
    members = classes.select("fingerprint", "doc", F.explode(F.array(*keys)).alias("key"))

    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = sizes.select("key", F.ceil(F.col("n") / limit).alias("parts"))
    hot = stored(hot, "simhash-large")
    marked = members.join(hot, "key", "left")
    own = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(_part_of(F.col("parts"), 1))
    marked = marked.withColumn("own", own)
    # the first part of a large bucket goes to every other part
    to = F.when(F.col("parts").isNull() | (F.col("own") > 0), F.array("own"))
    to = to.otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0).cast("long"))))
    first = marked.select("key", "fingerprint", "doc", F.explode(to).alias("part"))
    links = stored(_linked(first, most).distinct(), "simhash-links")
    groups = components(links)

    if not hot.isEmpty():
        named = groups.select(F.col("node").alias("doc"), "component")
        large = marked.where("parts is not null").join(named, "doc", "left")
        large = stored(large.withColumn("component", F.coalesce("component", "doc")), "simhash-large-members")
        counts = large.groupBy("key", "component").agg(F.count("*").alias("n"))
        shape = counts.groupBy("key").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("others")
        )
        shape = shape.where("others > 0").withColumn("chunks", F.ceil(F.col("others") / limit))
        large = large.join(shape, "key")
        chunk = _part_of(F.col("chunks"), 2)
        inside = large.select("key", "fingerprint", "doc", "parts", F.col("own"), _all_parts(F.col("chunks")).alias("chunk"))
        outside = large.where("component <> main")
        outside = outside.select("key", "fingerprint", "doc", "parts", _all_parts(F.col("parts")).alias("own"), chunk.alias("chunk"))
        met = inside.unionByName(outside).select(
            "key", "fingerprint", "doc", (F.col("own") + F.col("parts") * F.col("chunk")).alias("part")
        )
        more = stored(_linked(met, most).distinct(), "simhash-links")
        if not more.isEmpty():
            stars = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
            groups = components(stars.union(more))

    named = classes.join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("fingerprint", F.coalesce("component", "doc").alias("component"))
    out = rows.join(named, "fingerprint", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
