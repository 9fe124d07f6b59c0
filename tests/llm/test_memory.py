"""What tasks hold at a time, in proportion to their text."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rolescope.llm import byte_bpe, ngram_lm, queries, toxicity
from rolescope.llm import words as W


def _peak(run):
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_tokens_of_a_block_are_found_some_rows_at_a_time():
    texts = [" ".join(f"Wd{i * j % 977}" for j in range(200)) for i in range(6000)]
    texts[3], texts[7] = None, ""
    table = pa.table({"text": pa.array(texts, pa.string())})
    size = sum(len(t or "") for t in texts)
    W.powers(1 << 17)  # kept from then on
    most, (key, row, first) = _peak(lambda: ngram_lm._tokens(table))
    assert most < 8 * size  # 12 times the text when the words of the whole block were held
    w = W.words(table["text"], fold=True)
    assert (first == w.first + np.arange(len(texts) + 1)).all()
    assert (row == np.repeat(np.arange(len(texts)), np.diff(first))).all()
    assert (key[first[1:] - 1] == ngram_lm.END).all()
    assert (np.delete(key, first[1:] - 1) == w.hash | np.uint64(4)).all()


def test_word_features_keep_no_powers_for_the_whole_sample():
    texts = [" ".join(f"Wd{i * j % 977}" for j in range(200)) for i in range(1000)]
    w = W.words(pa.array(texts, pa.string()), fold=True, breaks=W.NOT_ALNUM)
    W._powers.cache_clear()
    tracemalloc.start()
    try:
        keys = toxicity._keys(w)
        kept = tracemalloc.get_traced_memory()[0] - sum(k.nbytes for k in keys[1:])  # the first are the words' own
    finally:
        tracemalloc.stop()
    # tables of two numbers a byte of text stayed with the process, the driver's too
    assert kept < len(w.data) / 4


def test_bpe_plans_hold_no_rank_map(spark):
    letters = [bytes([i]) for i in range(256)]
    ranks = {t: i for i, t in enumerate([*letters, *(a + b for a in letters[64:128] for b in letters[64:128])])}
    docs = spark.createDataFrame([(1, "ABBA BAAB"), (2, None), (3, "xyz ABC")], "doc_id long, text string")
    out = byte_bpe.encode(docs, ranks, r"\S+|\s+")
    assert len(out._jdf.queryExecution().toString()) < 60_000  # over 100,000 with the map of 4,096 pairs as a literal
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[1] == [ranks[t] for t in (b"AB", b"BA", b" ", b"B", b"AA", b"B")] and not got[2]  # AA ranks before AB
    assert got[3] == [ranks[t] for t in (b"xy", b"z", b" ", b"AB", b"C")]


def test_arrow_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows]), "size": pa.array([batch.nbytes])})

    def query(spark, folder):
        rows = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
        return rows.mapInArrow(sizes, "rows long, size long")

    got = queries._held(query)(spark, "").collect()
    assert sum(r.rows for r in got) == 40
    assert max(r.size for r in got) < 6 << 20  # one batch of 40 MB with a bound on rows alone


def test_pieces_are_looked_up_some_at_a_time():
    pieces = [b"%08d" % i for i in range(100_000)]
    ids = [[i, i % 7, 3][: 1 + i % 3] for i in range(100_000)]
    folded = byte_bpe.Folded(
        [pa.table({"piece": pa.array(pieces, pa.binary()), "ids": pa.array(ids, pa.list_(pa.int32()))})]
    )
    asked = pieces[::-1] + [b"none", b""]
    data, ends = byte_bpe._flat(pa.array(asked, pa.binary()))
    W.powers(1 << 17)  # kept from then on
    most, number = _peak(lambda: folded.find(data, ends))
    assert most < 12 * len(data)  # 25 times the pieces' bytes when all were looked up at once
    assert number[-2:].tolist() == [-1, -1]
    own, lengths = np.array([70, 71, 72], np.int32), np.array([2, -1, 1, *np.diff(folded.id_ends)[number[:-2]]])
    start = np.array([0, 0, 2, *(folded.id_ends[number[:-2]] + len(own))])
    known = byte_bpe._known(own, folded.ids, start, lengths)
    assert known.tolist() == [70, 71, 72, *(x for i in ids[::-1] for x in i)]
    assert not len(byte_bpe._known(own[:0], own[:0], start[:0], lengths[:0]))
    none = byte_bpe.Folded([])
    assert none.find(data, ends).tolist() == [-1] * len(asked) and not len(folded.find(data[:0], ends[:1]))
