"""Removes passages whose words already occurred earlier in the corpus.

Every run of ``window`` consecutive words of every text is hashed (Rabin-Karp) and counted
over the whole corpus; a run that also starts earlier is removed, and overlapping runs
merge into maximal intervals.

The corpus is cut into blocks of consecutive documents (by ``doc_id``). A block sends each
of its distinct window hashes once, packed by hash range, so a passage that half the corpus
shares costs one hash a block. The task of a range sees which blocks hold a hash; as blocks
are in order of documents, a bit for each hash sent tells the block whether an earlier
block has it. No row of the answer depends on how many copies there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Bytes of text in a block and window hashes in a hash range.
BLOCK_BYTES = 8 << 20
RANGE_HASHES = 2 << 20
_LEAST = -(1 << 63)


def by_doc_order(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Numbers blocks of neighbouring documents of about ``block_bytes``; gives the bytes of all texts too.

    Block limits are percentiles of doc_id weighted by text length, taken over all rows.
    """
    key = F.coalesce("doc_id", F.lit(_LEAST))
    docs = docs.select("doc_id", "text", key.alias("at"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    if n == 1:
        return docs.withColumn("block", F.lit(0)), total
    weight = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 2048).cast("int") + 1
    each = docs.select(F.explode(F.array_repeat("at", weight)).alias("at"))
    cuts = F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n)
    limits = sorted(set(each.agg(cuts).first()[0]))
    # the block is the number of limits below the document
    low = F.lit(limits)
    block = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, len(limits)).bit_length())),
        F.struct(F.lit(0).alias("a"), F.lit(len(limits)).alias("b")),
        lambda s, _: _halve(s, low),
        lambda s: s["a"],
    )
    return docs.withColumn("block", block), total


def _halve(s, limits):
    """One step of a binary search for the first limit that is not below ``at``."""
    mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
    below = (s["a"] < s["b"]) & (F.get(limits, mid) < F.col("at"))
    return F.struct(
        F.when(below, mid + 1).otherwise(s["a"]).alias("a"),
        F.when(below | (s["a"] >= s["b"]), s["b"]).otherwise(mid).alias("b"),
    )


def _windows(table: pa.Table, window: int):
    """A block in order of documents, its words, and the windows: start, number of the distinct hash, first or not."""
    table = table.sort_by([("at", "ascending"), ("text", "ascending")])
    w = W.words(table["text"])
    at, hashes = w.windows(window)
    distinct, _, number = W.grouped(hashes)
    first = np.full(len(distinct), len(at))
    np.minimum.at(first, number, np.arange(len(at)))
    is_first = np.zeros(len(at), dtype=bool)
    is_first[first] = True
    return table, w, at, distinct, number, is_first


def _limits(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins in sorted hashes."""
    part = (distinct >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))


def spans(docs: DataFrame, window: int = 20, block_bytes: int = BLOCK_BYTES, range_hashes: int = RANGE_HASHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans of removed words [start, end), text left.

    The text left is the kept words joined by one blank. Rows are ordered by doc_id, then by
    text; a null doc_id comes first, and a null text has no words. Texts of fewer words than
    the window are kept whole. Other columns are not passed on.
    """
    blocks, total = by_doc_order(docs, block_bytes)
    ranges = int(total // (6 * range_hashes)) + 1

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        distinct = _windows(table, window)[3]
        at = _limits(distinct, ranges)
        sent = [i for i in range(ranges) if at[i] < at[i + 1]]
        packed = [distinct[at[i] : at[i + 1]].tobytes() for i in sent]
        return pa.table(
            {"block": pa.array([block] * len(sent), pa.int32()), "part": pa.array(sent, pa.int32()), "hashes": pa.array(packed, pa.binary())}
        )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        sent = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]
        hashes = np.concatenate(sent)
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(hashes), dtype=bool)
        again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        cuts = np.cumsum([len(x) for x in sent])[:-1]
        packed = [np.packbits(x).tobytes() for x in np.split(again, cuts)]
        return pa.table({"block": table["block"], "part": table["part"], "bits": pa.array(packed, pa.binary())})

    def answer(block: pa.Table, bits: pa.Table) -> pa.Table:
        table, w, at, distinct, number, is_first = _windows(block, window)
        bits = bits.sort_by("part")
        limits = _limits(distinct, ranges)
        sizes = np.diff(limits)
        known = [
            np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8))[: sizes[p]]
            for p, x in zip(bits["part"].to_pylist(), bits["bits"])
        ]
        earlier = np.concatenate(known).astype(bool) if known else np.zeros(0, dtype=bool)
        gone = at[earlier[number] | ~is_first] if len(at) else at
        change = np.zeros(len(w) + 1, dtype=np.int32)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        removed = np.cumsum(change[:-1]) > 0
        return _result(table, w, removed)

    asked = blocks.groupBy("block").applyInArrow(ask, "block int, part int, hashes binary")
    told = asked.groupBy("part").applyInArrow(compare, "block int, part int, bits binary")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, text string"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, schema)


def _result(table: pa.Table, w: W.Words, removed: np.ndarray) -> pa.Table:
    n = table.num_rows
    gone = np.bincount(w.row[removed], minlength=n)
    # intervals: runs of removed words of one row
    joined = removed[1:] & removed[:-1] & (w.row[1:] == w.row[:-1])
    opens, shuts = removed.copy(), removed.copy()
    opens[1:] &= ~joined
    shuts[:-1] &= ~joined
    opens, shuts = np.flatnonzero(opens), np.flatnonzero(shuts)
    base = w.first[w.row[opens]]
    offsets = np.searchsorted(w.row[opens], np.arange(n + 1))
    pairs = pa.StructArray.from_arrays(
        [pa.array(opens - base, pa.int32()), pa.array(shuts + 1 - base, pa.int32())], ["start", "end"]
    )
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "n_words": pa.array(w.counts(), pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
            "text": joined_words(w, ~removed),
        }
    )


def joined_words(w: W.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one blank."""
    n = len(w.first) - 1
    at = np.flatnonzero(keep)
    row = w.row[at]
    length = w.end[at] - w.start[at]
    follows = np.zeros(len(at), dtype=bool)  # another kept word of the row follows
    follows[:-1] = row[1:] == row[:-1]
    size = length + follows
    begin = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(size, out=begin[1:])
    out = np.full(begin[-1], 0x20, dtype=np.uint8)
    for a in range(0, len(at), 1 << 17):
        b = min(len(at), a + (1 << 17))
        many = length[a:b]
        out[W.runs(begin[a:b], many)] = w.data[W.runs(w.start[at[a:b]], many)]
    offsets = begin[np.searchsorted(row, np.arange(n + 1))]
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return text.cast(pa.string())
