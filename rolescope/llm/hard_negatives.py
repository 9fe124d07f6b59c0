"""Hard negatives of anchors, by slots between the upper limits of their positives.

An anchor's positives are the rows of its label that score highest. Each positive wants the
highest negatives inside a window of scores, from ``low`` to ``high`` percent of its own. The
windows overlap, so they are not searched one by one: the upper limits of the positives,
highest first, cut the scores into disjoint slots, and a negative falls into one slot.

1. Anchors are stated by the caller. They go to the tasks in blocks of a fixed size, and
   every block meets all rows where they lie; no row is shuffled.
2. Each task keeps the best rows per anchor (positives), then, with the limits known, the
   best rows per anchor and slot. What tasks kept is merged with the same order.
3. Suffix merges, lowest slot first, give the best of a slot and all below it. The window
   of a positive is the part of its slot's merge that its lower limit leaves.

Scores are exact integers: components become floor(scale * x).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import pick
from .store import shared_path, stored

#: Anchors sent to the tasks at once, and scores worked on at a time.
BLOCK, CELLS = 2048, 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part: nothing null, all components finite."""
    rows = pick(rows, "vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.where(whole).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    )


def quantised(column, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of a list column as a matrix; shorter rows end in zeros, longer ones are cut at ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(scale * np.asarray(column.flatten(), dtype=np.float64)).clip(-1e300, 1e300)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    start = np.cumsum(sizes) - sizes
    for i in range(width):
        there = sizes > i
        out[there, i] = flat[start[there] + i]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stand at the limit."""
    # one by one the factors are finite, their product need not be
    largest = float(np.abs(rows).max(initial=0)) / 2**53 * float(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if largest < 1:
        return (rows @ anchors.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(rows).astype(object) @ whole(anchors).astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


class Best:
    """The ``k`` best distinct (score, vec_id) of each group: high scores first, then small ids."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, LEAST, dtype=np.int64)
        self.group, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (
            np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids))
        )
        order = np.lexsort((ids, ~score, group))
        group, score, ids = group[order], score[order], ids[order]
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        group, score, ids = group[new], score[new], ids[new]
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
        keep = place < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.floor[group[last]] = score[last]


class Anchors:
    """A block of anchors; ``uppers`` and ``least`` are set when their positives are known."""

    def __init__(self, table: pa.Table, scale: int):
        self.id = np.asarray(table["vec_id"], dtype=np.int64)
        self.label = np.asarray(table["label"], dtype=np.int64)
        self.vectors = quantised(table["embedding"], scale)
        self.uppers, self.least = None, None

    def limit(self, found: pa.Table, positives: int, low: int, high: int) -> None:
        """Takes up the positives' scores: upper limits, highest first, and the lowest score any window holds."""
        self.uppers = np.full((len(self.id), positives), LEAST, dtype=np.int64)
        self.least = np.full(len(self.id), MOST, dtype=np.int64)
        for anchor, scores in zip(found["anchor"].to_pylist(), found["scores"].to_pylist(), strict=True):
            scores = [s for s in scores if s >= 0]  # the window of a lower one is empty
            if scores:
                self.uppers[anchor, : len(scores)] = [high * s // 100 for s in scores]
                self.least[anchor] = min(-(-low * s // 100) for s in scores)


def _chunks(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: int):
    """vec_id and label of some rows, and their scores with all anchors."""
    step = max(1, CELLS // max(1, len(anchors.id)))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            rows = quantised(part["embedding"], scale, anchors.vectors.shape[1])
            ids, labels = (np.asarray(part[c], dtype=np.int64) for c in ("vec_id", "label"))
            yield ids, labels, products(rows, anchors.vectors)


def _kept(best: Best, slots: int) -> pa.RecordBatch:
    values = (best.group // slots, best.group % slots, best.score, best.id)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["anchor", "slot", "score", "vec_id"])


KEPT = "anchor long, slot long, score long, vec_id long"


def _best_of(kept: DataFrame, k: int, *by: str) -> DataFrame:
    """What the tasks kept, merged: ``best``, at most k of each group in order."""
    entry = F.struct(F.bitwise_not("score").alias("down"), "vec_id")
    return kept.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("best"))


def _suffixes(slots: Column, number: int, k: int) -> Column:
    """For each slot the best ``k`` of it and all slots below, from a map of slots."""
    none = F.array().cast("array<struct<down:bigint,vec_id:bigint>>")

    def below(done: Column, slot: Column) -> Column:
        merged = F.concat(F.coalesce(F.get(slots, slot), none), F.coalesce(F.get(done, F.lit(0)), none))
        return F.concat(F.array(F.slice(merged, 1, k)), done)

    start = F.array().cast("array<array<struct<down:bigint,vec_id:bigint>>>")
    return F.aggregate(F.sequence(F.lit(number - 1), F.lit(0)), start, below)


def _mine_block(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    # few long tasks: each hands on a list per anchor
    rows = rows.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism))
    sent = spark.sparkContext.broadcast(anchors)

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors.id), positives)
        for ids, labels, scores in _chunks(batches, anchors, scale):
            fits = (scores >= best.floor) & (labels[:, None] == anchors.label) & (ids[:, None] != anchors.id)
            row, anchor = np.nonzero(fits)
            best.add(anchor, scores[row, anchor], ids[row])
        yield _kept(best, 1)

    found = _best_of(rows.mapInArrow(same_label, KEPT), positives, "anchor")
    found = stored(found.withColumnRenamed("best", "positives"), "negatives-positives")
    scores = F.transform("positives", lambda p: F.bitwise_not(p["down"]))
    anchors.limit(found.select("anchor", scores.alias("scores")).toArrow(), positives, low, high)
    limited = spark.sparkContext.broadcast(anchors)

    def other_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = limited.value
        best = Best(len(anchors.id) * positives, negatives)
        for ids, labels, scores in _chunks(batches, anchors, scale):
            # nothing below the lowest slot's last kept row can count, whatever its slot
            used = (anchors.uppers > LEAST).sum(axis=1)
            lowest = np.arange(len(anchors.id)) * positives + np.maximum(used - 1, 0)
            least = np.maximum(anchors.least, best.floor[lowest])
            fits = (scores >= least) & (scores <= anchors.uppers[:, 0]) & (labels[:, None] != anchors.label)
            row, anchor = np.nonzero(fits)
            score = scores[row, anchor]
            group = anchor * positives + (anchors.uppers[anchor] >= score[:, None]).sum(axis=1) - 1
            good = score >= best.floor[group]
            best.add(group[good], score[good], ids[row[good]])
        yield _kept(best, positives)

    kept = _best_of(rows.mapInArrow(other_label, KEPT), negatives, "anchor", "slot")
    entries = F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "best"))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)),
        lambda i: F.get(F.filter("entries", lambda e: e["slot"] == i), F.lit(0))["best"],
    )
    merged = kept.groupBy("anchor").agg(entries.alias("entries")).withColumn("slots", slots)
    merged = merged.select("anchor", _suffixes(F.col("slots"), positives, negatives).alias("windows"))
    ids = spark.createDataFrame(
        pa.table({"anchor": pa.array(range(len(anchors.id)), pa.int64()), "anchor_id": pa.array(anchors.id)})
    )
    each = found.join(merged, "anchor").join(ids, "anchor")
    each = each.select("anchor_id", "windows", F.posexplode("positives").alias("place", "positive"))
    exact = lambda c: F.bitwise_not(c).cast("decimal(20,0)")
    own = exact(F.col("positive.down"))

    def inside(n: Column) -> Column:
        return (low * own <= 100 * exact(n["down"])) & (100 * exact(n["down"]) <= high * own)

    window = F.filter(F.get("windows", F.col("place")), inside)
    each = each.select("anchor_id", "positive", F.posexplode(window).alias("before", "negative"))
    return each.select(
        "anchor_id",
        F.col("positive.vec_id").alias("positive_id"),
        (F.col("before") + 1).alias("rank"),
        F.col("negative.vec_id").alias("negative_id"),
        F.bitwise_not("positive.down").alias("positive_score"),
        F.bitwise_not("negative.down").alias("negative_score"),
    )


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label (whole numbers), embedding (list of floats); ``anchor`` marks the
    anchors among them. A score is the inner product of two rows' floor(scale * component);
    scores beyond 64 bits stand at the limit, a vector shorter than the other counts as ending
    in zeros, and an empty one scores 0. Rows with a null vec_id, label, vector or component,
    or a component that is not finite, take no part. Higher scores come first, ties by smaller
    vec_id. An anchor's positives are its best ``positives`` rows of the same label and another
    vec_id; each gets the best ``negatives`` rows of other labels that score from ``low`` to
    ``high`` percent of it. Fewer are returned where there are fewer; an anchor without
    positives, and an empty table, give no rows. Repeated rows count once. Rows that share a
    vec_id and differ otherwise are rows of their own, as anchors too. Other columns are
    ignored, whatever their names.

    Tasks hold one block of anchors, with a list for each; the driver sees one block at a time.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    anchors = rows.where(anchor).distinct()
    number = -(-anchors.count() // block)
    done = shared_path(spark, "negatives-found")
    spark.createDataFrame([], RESULT).write.parquet(done)
    if number:
        dealt = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(number)).cast("int")
        path = shared_path(spark, "negatives-anchors")
        anchors = anchors.withColumn("block", dealt).repartition("block")
        anchors.write.partitionBy("block").parquet(path)
        anchors = spark.read.schema(anchors.schema).parquet(path)
    for i in range(number):
        table = anchors.where(F.col("block") == i).select("vec_id", "label", "embedding").toArrow()
        if table.num_rows:
            found = _mine_block(rows, Anchors(table, scale), positives, negatives, low, high, scale)
            found.write.mode("append").parquet(done)
    return spark.read.schema(RESULT).parquet(done)
