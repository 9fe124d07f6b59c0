"""Scores texts with a two-level n-gram trie learned from the corpus.

Levels: contexts (first words of bigrams) in order, each with an Elias-Fano pointer to its
first successor; successors as context-relative numbers, made monotone over the level and
Elias-Fano coded too; and an 8-bit code of every successor's share of its context. A trie
lies in a file that the task maps into memory. Looking a bigram up is a search for its
context, then the successor search inside that context's run.

Probabilities are smoothed towards the unigram estimate with Dirichlet weight ``weight``:
p(w|u) = (c(uw) + weight * p(w)) / (c(u) + weight), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

No task sees the whole model. Texts are dealt to blocks; a block sends each of its distinct
words, then bigrams, once with its count in the training texts, packed by key. The task of
a key range adds the counts of all blocks, builds its part of the trie and answers each
block's list. Successors of a frequent context are spread over several parts, in proportion
to the context's count.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elias_fano as ef
from . import words as W
from .store import stored

BLOCK_BYTES = 12 << 20
#: Text of a block whose words are found at a time.
TOKENS_BYTES = 1 << 20
PART_TOKENS = 2 << 20
#: Keys that stand for the end of a text and, as a context, for its beginning.
END, START = np.uint64(1), np.uint64(2)
#: 8-bit codes: steps of log10; the last code says that the trie has no such bigram.
STEP, ABSENT = 1 / 24, 255


def _encode(share: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(share) / STEP), ABSENT - 1).astype(np.uint8)


SHARES = np.append(10.0 ** (-STEP * np.arange(ABSENT)), 0.0)


class Trie:
    """One part of the model in a memory-mapped file."""

    def __init__(self, path: Path):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        sizes = data[:64].view(np.int64).tolist()
        contexts, words, length, width, high, pointer_width, pointer_high = sizes[:7]
        at = 64

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            out = data[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += (out.nbytes + 7) // 8 * 8
            return out

        self.contexts, self.words = take(contexts, np.uint64), take(words, np.uint64)
        low = take(contexts + 1, ef.LOW_KINDS[pointer_width])
        self.pointers = ef.EliasFano(pointer_width, low, take(pointer_high, np.uint8), contexts + 1)
        low = take(length, ef.LOW_KINDS[width])
        self.successors = ef.EliasFano(width, low, take(high, np.uint8), length)
        self.codes = take(length, np.uint8)

    @staticmethod
    def write(path: Path, context: np.ndarray, word: np.ndarray, share: np.ndarray) -> None:
        """``context``, ``word``: keys of distinct bigrams in order of context, then word."""
        new = np.ones(len(context), dtype=bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        words, _, relative = W.grouped(word)
        monotone = (np.cumsum(new) - 1) * len(words) + relative
        pointer_width, pointer_low, pointer_high = ef.encode(np.append(first, len(context)), len(context) + 1)
        width, low, high = ef.encode(monotone, len(first) * len(words) + 1)
        sizes = [len(first), len(words), len(context), width, len(high), pointer_width, len(pointer_high), 0]
        with path.open("wb") as out:
            for part in (np.array(sizes), context[first], words, pointer_low, pointer_high, low, high, _encode(share)):
                raw = part.tobytes()
                out.write(raw + bytes(-len(raw) % 8))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each bigram."""
        codes = np.full(len(context), ABSENT, dtype=np.uint8)
        if not len(self.contexts):
            return codes
        c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        r = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = np.flatnonzero((self.contexts[c] == context) & (self.words[r] == word))
        c, r = c[known], r[known]
        at = self.successors.find(c * len(self.words) + r)
        inside = (at >= self.pointers[c]) & (at < self.pointers[c + 1])
        codes[known[inside]] = self.codes[at[inside]]
        return codes


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens of a block with the end of each text, their rows, and where rows begin."""
    rows = table.num_rows
    column, (_, offsets) = table["text"], W.text_bytes(table["text"])
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in W.pieces(offsets, TOKENS_BYTES):  # only hashes are kept, so words of some rows at a time do
        w = W.words(column.slice(a, b - a), fold=True)
        hashes.append(w.hash)
        counts.append(w.counts())
    first = np.append(0, np.cumsum(np.concatenate(counts) + 1))
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
    key = np.full(first[-1], END, dtype=np.uint64)
    word = np.ones(len(key), dtype=bool)
    word[first[1:] - 1] = False
    key[word] = np.concatenate(hashes) | np.uint64(4)
    return key, row, first


def _cut(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the runs of a sorted array of parts."""
    at = np.searchsorted(part, np.arange(parts + 1))
    return [(i, at[i], at[i + 1]) for i in range(parts) if at[i] < at[i + 1]]


def _raw(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in column]


def _scaled(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack5(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view(np.uint64).ravel()


def score(
    docs: DataFrame,
    train: Column,
    weight: float = 300.0,
    block_bytes: int = BLOCK_BYTES,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` marks the documents to learn from; all are scored. Tokens are the words with
    A-Z lower-cased, then one end. ``base_score`` is the log10 probability by unigrams,
    ``score`` by the trie. Words are told apart by 64-bit hashes, successors of a context by
    40-bit ones. A null text has only its end; rows are scored one by one, repeated or not.
    Without training documents every token has probability 1, and both scores are 0.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks_n = int(total // block_bytes) + 1
    parts = int(total // (6 * part_tokens)) + 1
    blocks = docs.select(
        "doc_id",
        "text",
        F.coalesce(train, F.lit(False)).alias("train"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks_n)).cast("int").alias("block"),
    )

    def ask_words(table: pa.Table) -> pa.Table:
        key, row, _ = _tokens(table)
        learn = table["train"].to_numpy(zero_copy_only=False)[row]
        distinct, _, number = W.grouped(key)
        counts = np.bincount(number[learn], minlength=len(distinct)).astype(np.uint32)
        runs = _cut(_scaled(distinct, parts), parts)
        block = table["block"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(runs), pa.int32()),
                "part": pa.array([p for p, _, _ in runs], pa.int32()),
                "keys": pa.array([distinct[a:b].tobytes() for _, a, b in runs], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for _, a, b in runs], pa.binary()),
            }
        )

    def count_words(table: pa.Table) -> pa.Table:
        sent = [x.view(np.uint64) for x in _raw(table["keys"])]
        counts = np.concatenate([x.view(np.uint32) for x in _raw(table["counts"])])
        distinct, _, number = W.grouped(np.concatenate(sent))
        total = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)
        told = np.split(total[number], np.cumsum([len(x) for x in sent])[:-1])
        once = [1] + [0] * (len(sent) - 1)
        return pa.table(
            {
                "block": table["block"],
                "part": table["part"],
                "counts": pa.array([x.tobytes() for x in told], pa.binary()),
                "tokens": pa.array([int(total.sum()) * x for x in once], pa.int64()),
                "types": pa.array([int((total > 0).sum()) * x for x in once], pa.int64()),
            }
        )

    asked = blocks.groupBy("block").applyInArrow(ask_words, "block int, part int, keys binary, counts binary")
    told = asked.groupBy("part").applyInArrow(
        count_words, "block int, part int, counts binary, tokens long, types long"
    )
    word_counts = stored(told, "lm-words")
    tokens, types = word_counts.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = tokens or 0, types or 0
    below = tokens + 0.1 * (types + 1)

    def counted(table: pa.Table, counts: pa.Table):
        """Distinct tokens of a block, each token's place among them, their counts."""
        key, row, first = _tokens(table)
        distinct, _, number = W.grouped(key)
        counts = counts.sort_by("part")
        known = [x.view(np.int64) for x in _raw(counts["counts"])]
        return key, row, first, number, np.concatenate(known) if known else np.zeros(0, np.int64)

    def bigrams(key, first, number, known):
        """Distinct bigrams of a block in order of part, context, word; each token's place among them."""
        pair = np.empty_like(number)
        pair[1:] = number[:-1]
        pair[first[:-1]] = len(known)
        pair *= len(known) + 1
        pair += number
        _, index, place = W.grouped(pair)
        del pair
        begins = np.zeros(len(key), dtype=bool)
        begins[first[:-1]] = True
        begins = begins[index]
        context = np.where(begins, START, key[index - 1])
        end = number[first[1:] - 1][:1]  # of the end, which all texts share: as many beginnings as ends
        times = known[np.where(begins, end, number[index - 1])]  # of the context
        word = W.mix(key[index]) & np.uint64((1 << 40) - 1)
        del index, begins
        spread = (times // part_tokens + 1).astype(np.uint64)
        part = _scaled(W.mix(context + word % spread), parts)
        del spread
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place = rank[place]
        del rank
        # one after another, so that only one of them is held twice
        part = part[order]
        context = context[order]
        word = word[order]
        times = times[order]
        return part, context, word, times, place

    def ask_bigrams(block: pa.Table, counts: pa.Table) -> pa.Table:
        key, row, first, number, known = counted(block, counts)
        part, context, word, times, place = bigrams(key, first, number, known)
        learn = block["train"].to_numpy(zero_copy_only=False)[row]
        count = np.bincount(place[learn], minlength=len(word)).astype(np.uint32)
        rows = []
        for p, a, b in _cut(part, parts):
            u = context[a:b]
            at = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            u = u[at]
            size = np.diff(np.append(at, b - a)).astype(np.uint32)
            rows.append((p, u.tobytes(), size.tobytes(), times[a:b][at].tobytes(), _pack5(word[a:b]), count[a:b].tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        names = ["contexts", "sizes", "times", "words", "counts"]
        out = {"block": pa.array([block["block"][0].as_py()] * len(rows), pa.int32()), "part": pa.array(columns[0], pa.int32())}
        return pa.table(out | {n: pa.array(c, pa.binary()) for n, c in zip(names, columns[1:], strict=True)})

    def answer_bigrams(table: pa.Table) -> pa.Table:
        sizes = [x.view(np.uint32) for x in _raw(table["sizes"])]
        each = np.concatenate(sizes)
        contexts, _, number = W.grouped(np.concatenate([x.view(np.uint64) for x in _raw(table["contexts"])]))
        times = np.zeros(len(contexts))
        times[number] = np.concatenate([x.view(np.int64) for x in _raw(table["times"])])
        word = np.concatenate([_unpack5(x) for x in _raw(table["words"])])
        count = np.concatenate([x.view(np.uint32) for x in _raw(table["counts"])])
        # contexts of a part are fewer than 2**24
        pair, _, place = W.grouped(np.repeat(number, each).astype(np.uint64) << np.uint64(40) | word)
        total = np.bincount(place, weights=count, minlength=len(pair))
        c, w = (pair >> np.uint64(40)).astype(np.int64), pair & np.uint64((1 << 40) - 1)
        seen = total > 0
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder, "part.trie")
            Trie.write(path, contexts[c[seen]], w[seen], total[seen] / (times[c[seen]] + weight))
            codes = Trie(path).find(contexts[c], w)[place]
        told = np.split(codes, np.cumsum([int(x.sum()) for x in sizes])[:-1])
        return pa.table(
            {"block": table["block"], "part": table["part"], "counts": pa.array([x.tobytes() for x in told], pa.binary())}
        )

    counts = word_counts.select("block", "part", "counts")
    asked = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        ask_bigrams, "block int, part int, contexts binary, sizes binary, times binary, words binary, counts binary"
    )
    codes = asked.groupBy("part").applyInArrow(answer_bigrams, "block int, part int, counts binary")

    def add_up(block: pa.Table, told: pa.Table) -> pa.Table:
        is_word = told["words"].to_numpy(zero_copy_only=False).astype(bool)
        key, row, first, number, known = counted(block, told.filter(pa.array(is_word)))
        part, context, word, times, place = bigrams(key, first, number, known)
        del key, part, context, word
        found = _raw(told.filter(pa.array(~is_word)).sort_by("part")["counts"])
        share = SHARES[np.concatenate(found) if found else np.zeros(0, np.uint8)]
        c = known[number]
        p = (c + 0.1) / below
        q = share[place] + weight * p / (times[place] + weight)
        n = block.num_rows
        sums = lambda x: np.bincount(row, weights=x, minlength=n)
        return pa.table(
            {
                "doc_id": block["doc_id"],
                "n_tokens": pa.array(np.diff(first), pa.int64()),
                "n_known": pa.array(sums(c > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, tokens, dtype=np.int64)),
                "base_score": pa.array(sums(np.log10(p))),
                "score": pa.array(sums(np.log10(q))),
            }
        )

    both = counts.withColumn("words", F.lit(1)).unionByName(codes.withColumn("words", F.lit(0)))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        add_up, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
