"""Finds benchmark items in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits with A-Z lower-cased. Every n-gram of an item is looked
up in all texts; how many texts hold it is counted first, and the item's n-grams that are
not much more frequent than its median are its seeds. (An item that leaked often has
frequent n-grams throughout; its median rises with them.) Seeds of one item on neighbouring
diagonals mark a passage, and the alignment of passage and item scores it: +2 a word alike,
-1 a word changed, left out or put in, so edited copies still score high.

The items travel to the tasks in blocks of bounded size; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

MATCH, CHANGE, GAP = 2, -1, -1
#: Words of items in a block.
BLOCK_WORDS = 1 << 18


@dataclass
class Items:
    """A block of items: ids, words, and all n-grams in order of hash with item and offset."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], size: int) -> Items:
        w = W.words(pa.array([t for _, t in rows], pa.string()), fold=True, breaks=W.NOT_ALNUM)
        at, grams = w.windows(size)
        order = np.argsort(grams, kind="stable")
        item = w.row[at]
        texts = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        return cls([i for i, _ in rows], texts, grams[order], item[order], (at - w.first[item])[order])

    def only(self, keep: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.grams[keep], self.item[keep], self.offset[keep])


class _Lookup:
    """Which of many hashes are among the grams: a table on the leading bits, then binary search."""

    def __init__(self, grams: np.ndarray):
        self.distinct = np.unique(grams)
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.distinct >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes found, and their numbers among the distinct grams."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.distinct, hashes[at]), len(self.distinct) - 1)
        same = self.distinct[number] == hashes[at]
        return at[same], number[same]


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first and last+1 word of the passage in it."""
    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        row, columns = np.zeros(len(b) + 1, dtype=np.int64), np.arange(1, len(b) + 1)
        top = (0, 0, 0)
        for i, word in enumerate(a):
            step = np.maximum(row[:-1] + np.where(b == word, MATCH, CHANGE), row[1:] + GAP)
            step = np.maximum(step, 0)
            # a gap along the row: the best earlier cell less its distance
            row[1:] = np.maximum.accumulate(step - GAP * columns) + GAP * columns
            j = int(row.argmax())
            if row[j] > top[0]:
                top = (int(row[j]), i + 1, j)
        return top

    score, end, column = best(passage, item)
    if not score:
        return 0, 0, 0
    _, back, _ = best(passage[:end][::-1], item[:column][::-1])
    return score, end - back, end


def _passages(start: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Merges sorted seed diagonals no further apart than ``most``."""
    cuts = np.flatnonzero(np.diff(start) > most) + 1
    return [(int(g[0]), int(g[-1])) for g in np.split(start, cuts)]


def _counted(docs: DataFrame, items: Items, size: int) -> np.ndarray:
    """How many texts hold each gram of the block."""
    sent = docs.sparkSession.sparkContext.broadcast(items.grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(sent.value)
        total = np.zeros(len(look.distinct), dtype=np.int64)
        for table in W.batches(batches):
            w = W.words(table["text"], fold=True, breaks=W.NOT_ALNUM)
            at, hashes = w.windows(size)
            place, number = look(hashes)
            once = np.unique(w.row[at[place]].astype(np.int64) * len(look.distinct) + number)
            total += np.bincount(once % len(look.distinct), minlength=len(total))
        held = np.flatnonzero(total)
        yield from pa.table({"gram": held, "docs": total[held]}).to_batches()

    counts = docs.select("text").mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    out = np.zeros(len(np.unique(items.grams)), dtype=np.int64)
    for r in counts.collect():  # at most as many as the block has grams
        out[r.gram] = r.docs
    return out


def _seeds(items: Items, docs_of: np.ndarray) -> Items:
    """The grams of each item that are not much more frequent than its median."""
    docs = docs_of[np.searchsorted(np.unique(items.grams), items.grams)]
    order = np.argsort(items.item, kind="stable")
    each = np.split(docs[order], np.searchsorted(items.item[order], np.arange(1, len(items.ids))))
    median = np.array([np.median(x) if len(x) else 0 for x in each])
    return items.only(docs <= 2 * median[items.item] + 10)


def _hits(docs: DataFrame, items: Items, size: int, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def one(words: np.ndarray, first: int, own: np.ndarray, low: int, high: int) -> tuple | None:
        slack = len(own) // 2 + 2
        a, b = max(first, low - slack), min(len(words), high + len(own) + slack)
        passage = words[a:b]
        # no alignment scores more than its words in common allow
        if np.isin(passage, own).sum() < least * len(own):
            return None
        score, start, end = align(passage, own)
        score /= MATCH * len(own)
        return (score, a + start - first, a + end - first) if score >= least else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        look = _Lookup(block.grams)
        begin = np.searchsorted(block.grams, look.distinct)
        end = np.searchsorted(block.grams, look.distinct, side="right")
        for table in W.batches(batches):
            w = W.words(table["text"], fold=True, breaks=W.NOT_ALNUM)
            at, hashes = w.windows(size)
            place, number = look(hashes)
            times = end[number] - begin[number]
            use = np.repeat(begin[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            diagonal = np.repeat(at[place], times) - block.offset[use]
            row, item = np.repeat(w.row[at[place]], times), block.item[use]
            order = np.lexsort((diagonal, item, row))
            row, item, diagonal = row[order], item[order], diagonal[order]
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
                if a == b:
                    continue
                r, i = int(row[a]), int(item[a])
                stop = int(w.first[r + 1])
                best = None
                for low, high in _passages(diagonal[a:b], len(block.words[i])):
                    found = one(w.hash[:stop], int(w.first[r]), block.words[i], low, high)
                    best = max(best, found, key=lambda x: x[0]) if best and found else best or found
                if best:
                    out.append((table["doc_id"][r].as_py(), block.ids[i], *best))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            names = ("doc_id", "item_id", "score", "start", "end")
            yield from pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, item_id long, score double, start int, end int"
    )


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[Items]:
    rows, words = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        words += len(r.text) // 4 + 1
        if words >= block_words:
            yield Items.of(rows, size)
            rows, words = [], 0
    if rows:
        yield Items.of(rows, size)


def matches(
    docs: DataFrame, benchmark: DataFrame, size: int = 3, least: float = 0.4, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, score, start, end (words of the text).

    ``score`` is the best alignment's share of the score of an exact copy; ``least`` bounds it
    from below. Items of fewer words than ``size`` match nothing, nor do null items or texts.
    Repeated documents or items give a row each; columns beyond ids and texts are ignored.
    """
    out = None
    for items in _blocks(benchmark, size, block_words):
        if not len(items.grams):
            continue
        hits = _hits(docs, _seeds(items, _counted(docs, items, size)), size, least)
        out = hits if out is None else out.union(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start int, end int")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 3, least: float = 0.4) -> DataFrame:
    """The documents in which no item is found. A null doc_id is never found."""
    return docs.join(matches(docs, benchmark, size, least).select("doc_id").distinct(), "doc_id", "left_anti")
