"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

Texts are cut into pieces by the tokenizer's pattern, and Spark folds the merges over each
distinct piece: a step looks up all neighbouring pairs in a rank map and joins the leftmost
pair of lowest rank. The map is an array of slots, a scalar subquery's; a pair is in one of two
slots (remainders by two primes).

1. Documents are cut into pieces once. A batch of them is stored as one row: the documents as
   packed lists of piece numbers, and the batch's distinct pieces.
2. Pieces that several batches hold are counted over the table, and the most frequent are
   folded once. Their number is bounded, so they are sent to all tasks as flat arrays.
3. Spark folds the pieces that are left in a batch, a row each behind the batch's own.
   Documents then take their ids from their pieces.

Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from . import words as W
from .columns import pick
from .store import stored

Batches = Iterator[pa.RecordBatch]
#: Text in a row of pieces. Pieces of more bytes than LONG are merged with a heap, which
#: takes n log n steps where the fold takes n * n; the merges are the same.
ROW_BYTES, LONG = 4 << 20, 48
#: Pieces folded once for all batches, at most; how many of them pass the driver at a time.
FREQUENT, SLICE = 1 << 20, 1 << 17
#: Pieces whose bytes or ids are looked up at a time.
SOME = 1 << 14
#: Rank of a pair that does not merge, and an empty slot. A piece has at most 255 bytes where Spark folds it.
NONE, EMPTY = 1 << 20, 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """``left << 20 | right`` and the rank of their join, for all pairs of tokens whose join is a token."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = rank
    return pairs


def _primes(least: int) -> tuple[int, int]:
    found, n = [], least | 1
    while len(found) < 2:
        if all(n % k for k in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
        n += 2
    return found[0], found[1]


class PairTable:
    """Pairs in slots: the first by the remainder of one prime, the second, behind it, by another."""

    def __init__(self, pairs: dict[int, int]):
        size = max(64, int(len(pairs) * 0.75))
        while True:
            self.first, self.second = _primes(size)
            if self._fill(pairs):
                break
            size = size * 5 // 4

    def _fill(self, pairs: dict[int, int]) -> bool:
        self.slots = slots = [EMPTY] * (self.first + self.second)
        for key, rank in pairs.items():
            entry, at = key << 20 | rank, key % self.first
            for _ in range(500):  # an entry moved out goes to its other slot
                slots[at], entry = entry, slots[at]
                if entry == EMPTY:
                    break
                key = entry >> 20
                at = self.first + key % self.second if at < self.first else key % self.first
            else:
                return False
        return True

    def stored(self, spark: SparkSession) -> DataFrame:
        """One row: slots. A literal of that length would be in every plan, its texts and its tasks' closures."""
        slots = pa.array([self.slots], pa.list_(pa.int64()))
        return stored(spark.createDataFrame(pa.table({"slots": slots})), "bpe-slots")

    def rank(self, slots: Column, left: Column, right: Column) -> Column:
        """The rank of a pair of ids; NONE for one that does not merge or has a null in it."""
        key = F.shiftleft(left, 20) + right
        # an entry without its own key is a rank, one without another key a large number
        own = F.shiftleft(key, 20)
        hit = [F.get(slots, (key % self.first).cast("int")), F.get(slots, (key % self.second + self.first).cast("int"))]
        return F.least(*[x.bitwiseXOR(own) for x in hit], _long(NONE))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def merged(piece: Column, table: PairTable, slots: Column) -> Column:
    """The ids of a piece given as the ids of its bytes.

    The fold's state has an entry for each id: the rank of its pair with the next one, its
    first byte's place and itself, in one number. The least entry is the leftmost of the pairs
    of lowest rank.
    """
    low = (1 << 20) - 1
    id_of = lambda entry: entry.bitwiseAND(_long(low))

    def entry(left: Column, right: Column, rest: Column) -> Column:
        return F.shiftleft(table.rank(slots, left, right), 28) + rest

    def step(acc: Column, _: Column) -> Column:
        def join(at: Column) -> Column:
            least, before, after = F.get(acc, at - 1), F.get(acc, at - 2), F.get(acc, at + 1)
            joined = F.shiftright(least, 28)
            own = entry(joined, id_of(after), least.bitwiseAND(_long(255 << 20)) + joined)
            left = entry(id_of(before), joined, before.bitwiseAND(_long((1 << 28) - 1)))
            tail = F.slice(acc, at + 2, F.size(acc))
            return F.when(at > 1, F.concat(F.slice(acc, F.lit(1), at - 2), F.array(left, own), tail)).otherwise(
                F.concat(F.array(own), tail)
            )

        least = F.array_min(acc)
        return F.when(least < _long(NONE << 28), let(F.array_position(acc, least).cast("int"), join)).otherwise(acc)

    def fold(ids: Column) -> Column:
        place = lambda i: F.shiftleft(i.cast("bigint"), 20)
        start = F.transform(ids, lambda x, i: entry(x, F.get(ids, i + 1), place(i) + x))
        done = F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), start, step)
        return F.transform(done, lambda x: id_of(x).cast("int"))

    return let(piece.cast("array<bigint>"), fold)


def merge_long(piece: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges for a long piece, with a heap of its pairs."""
    ids, after, before = list(piece), list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    end = len(ids)
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(end - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= end or ids[j] != right:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < end:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else end
            if b < end and (r := pairs.get(ids[a] << 20 | ids[b])) is not None:
                heapq.heappush(heap, (r, a, ids[a], ids[b]))
    return [x for x in ids if x >= 0]


def _hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces that lie one after another; a bounded stretch at a time."""
    out = np.empty(len(ends) - 1, dtype=np.uint64)
    for a, b in W.pieces(ends, 1 << 17):
        cut = ends[a : b + 1] - ends[a]
        out[a:b] = W.spans_hash(W.BYTE_VALUES[data[ends[a] : ends[b]]], cut[:-1], cut[1:])
    return W.mix(out + np.diff(ends).astype(np.uint64))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list or binary array one after another, and where each entry begins and the last ends."""
    if not len(column):  # its offsets may be empty too
        values = np.asarray(column.values) if pa.types.is_list(column.type) else np.zeros(0, np.uint8)
        return values[:0], np.zeros(1, np.int64)
    if pa.types.is_list(column.type):
        offsets = np.asarray(column.offsets, dtype=np.int64)
        return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _taken(values: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in another order, as ``_flat`` gives them; some at a time, as places take more than values."""
    size = np.diff(ends)[order]
    parts = [values[:0]]
    for a in range(0, len(order), SOME):
        some = slice(a, a + SOME)
        parts.append(values[W.runs(ends[order[some]], size[some])])
    return np.concatenate(parts), np.append(0, np.cumsum(size))


def _known(own: np.ndarray, folded: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of the pieces with a length, from ``own`` and, behind it, ``folded``; some pieces at a time."""
    there, parts = np.flatnonzero(lengths >= 0), [own[:0]]
    for a in range(0, len(there), SOME):
        some = there[a : a + SOME]
        at = W.runs(start[some], lengths[some])
        ids, behind = np.empty(len(at), np.int32), at >= len(own)
        ids[~behind], ids[behind] = own[at[~behind]], folded[at[behind] - len(own)]
        parts.append(ids)
    return np.concatenate(parts)


class Folded:
    """Pieces, as byte ids, with the ids they merge to, in order of their hashes."""

    def __init__(self, tables: Iterable[pa.Table]):
        """``tables``: columns piece and ids, a slice of the pieces at a time."""
        none = (np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        parts = [none]
        for rows in tables:
            for batch in rows.to_batches():
                (data, ends), (ids, id_ends) = _flat(batch["piece"]), _flat(batch["ids"])
                parts.append((data.copy(), np.diff(ends), ids.astype(np.int32), np.diff(id_ends)))
        data, size, ids, id_size = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        ends = np.append(0, np.cumsum(size))
        hashes = _hashes(data, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.data, self.ends = _taken(data, ends, order)
        self.ids, self.id_ends = _taken(ids, np.append(0, np.cumsum(id_size)), order)

    def find(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece here; -1 for one that is not held. Some at a time, as places take more than bytes."""
        if not len(self.hashes):
            return np.full(len(ends) - 1, -1)
        parts = [self._find(data, ends[a : min(a + SOME, len(ends) - 1) + 1]) for a in range(0, len(ends) - 1, SOME)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _find(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = np.full(len(ends) - 1, -1)
        hashes, size = _hashes(data, ends), np.diff(ends)
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[slot] == hashes) & (self.ends[slot + 1] - self.ends[slot] == size))
        if len(hit):  # the bytes confirm
            length = size[hit]
            equal = data[W.runs(ends[hit], length)] == self.data[W.runs(self.ends[slot[hit]], length)]
            hit = hit[np.logical_and.reduceat(equal, np.cumsum(length) - length)]
            found[hit] = slot[hit]
        return found


def split(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """A row for each batch of documents: docs, ends and codes (packed), whole (ids of pieces that
    need no fold, null for the others), short (the others, as byte ids). Written once."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pair_ranks(ranks)))
    byte_ids = bytes(ranks[bytes([i])] for i in range(256))

    def run(batches: Batches) -> Batches:
        ranks, pairs = sent.value
        cut, press = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=1).compress
        for table in W.batches(batches, most=ROW_BYTES):
            numbers: dict[str, int] = defaultdict(count().__next__)
            codes, ends = [], [0]
            for text in table["text"].to_pylist():
                pieces = cut(text or "")
                codes.append(np.fromiter(map(numbers.__getitem__, pieces), np.int32, len(pieces)))
                ends.append(ends[-1] + len(pieces))
            whole, short = [], []
            for piece in numbers:
                raw = piece.encode()
                rank = ranks.get(raw)
                if rank is not None:
                    whole.append([rank])
                elif len(raw) > LONG:
                    whole.append(merge_long(list(raw.translate(byte_ids)), pairs))
                else:
                    whole.append(None)
                    short.append(raw.translate(byte_ids))
            # byte by byte: the high bytes of small numbers take next to nothing
            flat = np.concatenate([np.zeros(0, np.int32), *codes])
            packed = press(flat.view(np.uint8).reshape(-1, 4).T.tobytes())
            columns = {
                "docs": pa.array([table["doc_id"].combine_chunks().to_pylist()], pa.list_(pa.int64())),
                "ends": pa.array([np.array(ends, np.int64)], pa.list_(pa.int64())),
                "codes": pa.array([packed], pa.binary()),
                "whole": pa.array([whole], pa.list_(pa.list_(pa.int32()))),
                "short": pa.array([short], pa.list_(pa.binary())),
            }
            yield from pa.table(columns).to_batches()

    kinds = "docs array<bigint>, ends array<bigint>, codes binary, whole array<array<int>>, short array<binary>"
    return stored(docs.select("doc_id", "text").mapInArrow(run, kinds), "bpe-batches")


def _byte_ids(piece: Column) -> Column:
    letters = F.filter(F.split(F.decode(piece, "ISO-8859-1"), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c))


def fold_frequent(batches: DataFrame, table: PairTable, most: int, slots: DataFrame | None = None) -> Folded:
    """The pieces that most batches hold, at most ``most`` and none that one batch alone holds, folded once each."""
    slots = slots or table.stored(batches.sparkSession)
    pieces = batches.select(F.explode("short").alias("piece"))
    counted = stored(pieces.groupBy("piece").agg(F.count("*").alias("times")).where("times > 1"), "bpe-pieces")
    top = F.lit(1 << 16).cast("long")
    shape = counted.groupBy(F.least("times", top).alias("times")).count().collect()  # at most ``top`` rows
    least, held = None, 0
    for r in sorted(shape, reverse=True):
        if held + r["count"] > most:
            break
        least, held = r.times, held + r["count"]
    fold = let(F.col("slots"), lambda slots: merged(_byte_ids(F.col("piece")), table, slots))
    rows = counted.where(F.col("times") >= least) if held else counted.limit(0)
    rows = rows.repartition(max(1, -(-held // 8192))).withColumn("slots", slots.scalar())
    rows = stored(rows.select("piece", fold.alias("ids")), "bpe-folded")
    slices = max(1, -(-held // SLICE))
    own = F.pmod(F.xxhash64("piece"), F.lit(slices))
    return Folded(rows.where(own == i).toArrow() for i in range(slices))


def _encoded(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    most_frequent: int,
    then: Callable[[Batches], Batches],
    schema: str,
) -> DataFrame:
    """What ``then`` makes of doc_id and ids, in the process that gathers them."""
    table = PairTable(pair_ranks(ranks))
    slots = table.stored(docs.sparkSession)
    batches = split(pick(docs, "doc_id", "text"), ranks, pattern)
    sent = docs.sparkSession.sparkContext.broadcast(fold_frequent(batches, table, most_frequent, slots))
    kinds = "docs array<bigint>, ends array<bigint>, codes binary, lengths binary, known binary, piece binary"

    def look_up(batches: Batches) -> Batches:
        """A row per batch, then one for each piece that is still to fold, in order.

        lengths: ids of each piece of the batch, -1 for those to fold; known: the ids of the others.
        """
        folded = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                whole, short = batch["whole"][i].values, batch["short"][i].values
                lengths = np.asarray(whole.value_lengths().fill_null(-1)).astype(np.int64)
                waiting = np.flatnonzero(lengths < 0)
                data, ends = _flat(short)
                number = folded.find(data, ends)
                hit = number >= 0
                own, own_ends = _flat(whole.drop_null())
                # places in the batch's own ids, then, behind those, in the folded ones
                start = np.empty(len(lengths), dtype=np.int64)
                start[lengths >= 0] = own_ends[:-1]
                start[waiting[hit]] = folded.id_ends[number[hit]] + len(own)
                lengths[waiting[hit]] = folded.id_ends[number[hit] + 1] - folded.id_ends[number[hit]]
                known = _known(own.astype(np.int32), folded.ids, start, lengths)
                left = short.filter(pa.array(~hit))
                n, none = len(left), pa.nulls
                head = [batch[c].slice(i, 1) for c in ("docs", "ends", "codes")]
                head += [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (lengths, known)]
                names = ["docs", "ends", "codes", "lengths", "known", "piece"]
                yield pa.RecordBatch.from_arrays([*head, none(1, pa.binary())], names)
                for a in range(0, n, 1 << 14):
                    some = left.slice(a, 1 << 14)
                    blank = [none(len(some), x.type) for x in head]
                    yield pa.RecordBatch.from_arrays([*blank, some], names)

    def whole(batches: Batches) -> Iterator[tuple[dict, list]]:
        """A batch's row, and the folded ids of its pieces, which are the rows after it."""
        head, ids = None, []
        for batch in batches:
            at = np.flatnonzero(np.asarray(batch["docs"].is_valid()))
            for i, j in zip([-1, *at.tolist()], [*at.tolist(), batch.num_rows], strict=True):
                if i >= 0:
                    if head is not None:
                        yield head, ids
                    head, ids = batch.slice(i, 1), []
                if j > i + 1:
                    ids.append(batch["ids"].slice(i + 1, j - i - 1))
        if head is not None:
            yield head, ids

    def gather(batches: Batches) -> Batches:
        unpress = zstandard.ZstdDecompressor().decompress
        for head, folded in whole(batches):
            docs, ends = head["docs"][0].values, np.asarray(head["ends"][0].values)
            lengths, known = (np.frombuffer(head[c][0].as_buffer(), np.int32) for c in ("lengths", "known"))
            planes = np.frombuffer(unpress(head["codes"][0].as_py()), np.uint8).reshape(4, -1)
            codes = np.ascontiguousarray(planes.T).view(np.int32).ravel()
            parts = [_flat(x) for x in folded]
            sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(e) for _, e in parts]])
            flat = np.concatenate([known, *[x.astype(np.int32) for x, _ in parts]])
            lengths, there = lengths.astype(np.int64), lengths >= 0
            starts = np.empty(len(lengths), dtype=np.int64)
            starts[there] = np.cumsum(lengths[there]) - lengths[there]
            starts[~there] = np.cumsum(sizes) - sizes + len(known)
            lengths[~there] = sizes
            # some documents at a time, as their ids are many
            for a, b in W.pieces(ends, 1 << 18):
                used = codes[ends[a] : ends[b]]
                size = lengths[used]
                ids = flat[W.runs(starts[used], size)]
                total = np.append(0, np.cumsum(size))[ends[a : b + 1] - ends[a]]
                ids = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([docs[a:b], ids], ["doc_id", "ids"])

    def finish(batches: Batches) -> Batches:
        return then(gather(batches))

    # bound once: the array is long, and Spark looks it up at every mention
    fold = let(F.col("slots"), lambda slots: merged(_byte_ids(F.col("piece")), table, slots))
    rows = batches.mapInArrow(look_up, kinds)  # the rows keep their order up to the next step of the task
    rows = rows.withColumn("slots", slots.scalar())
    rows = rows.withColumn("ids", F.when(F.col("piece").isNotNull(), fold)).drop("piece", "slots")
    return rows.mapInArrow(finish, schema)


CODED = "doc_id long, ids array<int>"
DECODED = f"{CODED}, bytes binary, packed binary"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most_frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids (array<int>): one row per document.

    Ids are those of the rank file, without special tokens; a piece that is a token as a
    whole gets its id at once. A null text is an empty one and has no ids. Rows are encoded
    one by one, whatever their doc_id is; other columns are not passed on.
    """
    return _encoded(docs, ranks, pattern, most_frequent, lambda batches: batches, CODED)


def _decoder(docs: DataFrame, ranks: dict[bytes, int]) -> Callable[[Batches], Batches]:
    ordered = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        ordered[i] = token
    length = np.array([len(t) for t in ordered], dtype=np.int64)
    pieces = np.frombuffer(b"".join(ordered), dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, np.cumsum(length) - length, length))

    def run(batches: Batches) -> Batches:
        pieces, start, length = sent.value
        for batch in batches:
            raw, packed = [], []
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values
                if ids is not None:
                    ids = np.asarray(ids)
                raw.append(None if ids is None else pieces[W.runs(start[ids], length[ids])].tobytes())
                packed.append(None if ids is None else ids.astype("<u4").tobytes())
            columns = [batch["doc_id"], batch["ids"], pa.array(raw, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bytes", "packed"])

    return run


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``rows`` (doc_id, ids) with bytes, the tokens' bytes one after another, and packed,
    the ids as little-endian 32-bit numbers. Null ids give null."""
    return rows.select("doc_id", "ids").mapInArrow(_decoder(rows, ranks), DECODED)


def coded_and_decoded(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, most_frequent: int = FREQUENT
) -> DataFrame:
    """``decode`` of ``encode``, in one process a task instead of two."""
    return _encoded(docs, ranks, pattern, most_frequent, _decoder(docs, ranks), DECODED)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: the texts' ids and the text that they decode to."""
    back = coded_and_decoded(docs, ranks, pattern)
    text = F.decode("bytes", "UTF-8")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", text.alias("decoded"))
