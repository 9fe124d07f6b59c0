"""Importance resampling towards a target: documents drawn by the n-grams they share with it.

A document is normalised (words joined by one space) and scanned once; the CRC of every prefix
that ends with a word is stored. The CRC of any n-gram follows from two of them: appending n
bytes to a prefix shifts its CRC by n zero bytes, a linear map over GF(2), and
crc(prefix + rest) = shift(crc(prefix), n) xor crc(rest). So
crc(rest) = crc(prefix + rest) xor shift(crc(prefix), n), whatever n-gram it is.

An n-gram's CRC modulo ``buckets`` is its bucket. How often each bucket occurs in the corpus
and in the target gives the bucket's gain; the sum of a document's gains is its weight. Adding
Gumbel noise, seeded by the doc_id, and taking the highest scores draws without replacement
with chances in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .columns import pick
from .store import stored

BUCKETS, LONGEST = 10_000, 3
#: The polynomial of zlib's crc32, lowest power in the highest bit: a fixed value.
POLYNOMIAL = 0xEDB88320
#: Shift tables hold this many lengths a level; a longer n-gram takes one more level for each factor.
DIGITS = 64
#: Bytes to words: A-Z folded, everything of ASCII but letters and digits a blank.
PLAIN = bytes(32 if c < 0x80 and not chr(c).isalnum() else W.FOLD[c] for c in range(256))


def _looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given as a table for each byte of its argument."""
    out = table[0][crc & 255]
    for k in range(1, 4):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


@lru_cache(maxsize=1)
def _one_byte() -> tuple[np.ndarray, np.ndarray]:
    """CRC table of single bytes, and the map that appends one zero byte, as a table for each byte."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), crc >> np.uint32(1))
    values = np.arange(256, dtype=np.uint32)
    bytes_ = np.stack([values << np.uint32(8 * k) for k in range(4)])
    return crc, (bytes_ >> np.uint32(8)) ^ crc[bytes_ & 255]


@lru_cache(maxsize=12)
def shift_tables(level: int) -> np.ndarray:
    """For d < DIGITS: the map that appends d * DIGITS ** level zero bytes, as a table for each byte."""
    if level:
        below = shift_tables(level - 1)
        step = _looked_up(below[1], below[-1])
    else:
        step = _one_byte()[1]
    values = np.arange(256, dtype=np.uint32)
    tables = [np.stack([values << np.uint32(8 * k) for k in range(4)])]
    for _ in range(DIGITS - 1):
        tables.append(_looked_up(step, tables[-1]))
    return np.stack(tables)


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of prefixes after that many zero bytes more."""
    level, size = 0, size.astype(np.int64)
    while len(size) and size.any():
        tables, digit = shift_tables(level), size % DIGITS
        parts = [tables[digit, k, (crc >> np.uint32(8 * k)) & 255] for k in range(4)]
        crc = parts[0] ^ parts[1] ^ parts[2] ^ parts[3]
        level, size = level + 1, size // DIGITS
    return crc


class Prefixes:
    """Running CRCs of normalised documents: ``crc`` after each word, ``before`` at its first byte."""

    def __init__(self, texts: list[str | None]):
        crcs, sizes, counts = [], [], []
        for text in texts:
            words = (text or "").encode().translate(PLAIN).split()
            c = 0
            crcs.append(np.fromiter((c := crc32(b" " + w, c) for w in words), np.uint32, len(words)))
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            counts.append(len(words))
        self.counts = np.array(counts, dtype=np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.counts)
        self.crc = np.concatenate([np.zeros(0, np.uint32), *crcs])
        self.size = np.concatenate([np.zeros(0, np.int64), *sizes])
        before = np.zeros(len(self.crc), dtype=np.uint32)
        before[1:] = np.where(self.row[1:] == self.row[:-1], self.crc[:-1], 0)
        blank = ~before  # one more byte, the blank
        self.before = ~((blank >> np.uint32(8)) ^ _one_byte()[0][(blank ^ np.uint32(32)) & 255])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The row and the CRC of every run of n words."""
        last = len(self.row) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        at = np.flatnonzero(self.row[:last] == self.row[n - 1 :])
        ends = np.cumsum(self.size)
        size = ends[at + n - 1] - ends[at] + self.size[at] + n - 1
        return self.row[at], self.crc[at + n - 1] ^ shifted(self.before[at], size)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: features of all texts by bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for table in W.batches(batches):
            prefixes = Prefixes(table["text"].to_pylist())
            for n in range(1, longest + 1):
                total += np.bincount(prefixes.ngrams(n)[1] % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return pick(docs, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) of each bucket, target against corpus."""
    have = {r.bucket: r.n for r in bucket_counts(docs, buckets, longest).collect()}  # at most ``buckets`` rows
    want = {r.bucket: r.n for r in bucket_counts(target, buckets, longest).collect()}
    s_all, t_all = sum(have.values()), sum(want.values())
    ratio = [
        (float(want.get(b, 0)) + 1) * float(s_all + buckets) / ((float(have.get(b, 0)) + 1) * float(t_all + buckets))
        for b in range(buckets)
    ]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = 42, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row per document.

    ``score`` is the weight with Gumbel noise from the first 32 bits of sha256("seed:doc_id").
    A null or empty text has no features and weight 0. A null doc_id gives a null score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for table in W.batches(batches):
            rows = table.num_rows
            prefixes = Prefixes(table["text"].to_pylist())
            features, weight = np.zeros(rows, dtype=np.int64), np.zeros(rows)
            for n in range(1, longest + 1):
                row, crc = prefixes.ngrams(n)
                features += np.bincount(row, minlength=rows)
                weight += np.bincount(row, weights=gain[crc % len(gain)], minlength=rows)
            columns = [prefixes.counts, features, weight.astype(np.int64)]
            yield from pa.table(
                [table["doc_id"], *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"]
            ).to_batches()

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    chance = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))))


def ranked(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the documents drawn, null for the others.

    Of the N documents with a doc_id and ``least_words`` words or more, floor(percent * N / 100)
    are drawn: the highest scores, ties to smaller doc_ids; repeated rows count each. Rows are
    dealt by ranges of the order and sorted there; a rank is the number of rows in the ranges
    before and the place in its own.
    """
    rows = stored(scored.withColumn("tie", F.monotonically_increasing_id()), "importance-scored")
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    order = [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.asc("tie")]
    dealt = rows.where(fit).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "importance-sorted")
    # the upper bits are the number of the range, the lower 33 the place in it
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.part: r["count"] for r in dealt.groupBy(part.alias("part")).count().collect()}  # a row per range
    before, total = [], 0
    for i in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(i, 0)
    rank = F.get(F.array(*[F.lit(n).cast("long") for n in before]), part.cast("int")) + place + 1
    drawn = dealt.withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop("place")
    return drawn.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))).drop("tie")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document of ``docs``.

    ``target`` has texts of the wanted kind. Words are runs of letters and digits (A-Z folded)
    and of everything beyond ASCII; features are runs of one to three words. A null text has no
    words. Documents with a null doc_id are counted in the corpus and never drawn. Empty tables
    count as empty texts; nothing is drawn from an empty one. Other columns are ignored.
    """
    return ranked(weigh(docs, gains(docs, target, buckets), seed), percent, least_words)


def drawn_texts(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn; where a doc_id repeats, all of its rows."""
    return docs.join(ranks.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")
