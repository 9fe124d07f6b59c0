"""The registered queries on the small tables: SQL twins, contracts, and plans without Python where promised."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from checks.compare import difference, duck
from rolescope.llm import byte_bpe
from rolescope.llm.oracles import ORACLES
from rolescope.llm.queries import QUERIES

from . import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, name):
    assert difference(spark, duck(SMALL), SMALL, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_quality_rules", "op10_secret_scan"])
def test_native(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op3(spark, texts):
    out = QUERIES["op3_toxicity"](spark, SMALL).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op5(spark, texts):
    out = QUERIES["op5_jaccard_join"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.groups(texts.items())


def test_op7(spark, texts):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = QUERIES["op7_byte_bpe"](spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = tokenizer.encode_ordinary(texts[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == sha(texts[r.doc_id])


def test_op8(spark, texts):
    train = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    expected = dict(zip(texts, brute.language_model(texts.items(), train, 300.0), strict=True))
    for r in QUERIES["op8_ngram_lm"](spark, SMALL).collect():
        plain = expected[r.doc_id]
        assert r.held_out != train(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == plain[:3]
        assert r.base_score == pytest.approx(plain[3])


def test_op9(spark, texts):
    out = QUERIES["op9_substring_dedup"](spark, SMALL).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out}
    assert got == {d: (n, k, sha(t)) for d, n, k, t in brute.removed(texts.items())}


@pytest.mark.parametrize("name", ["op4_decontamination", "op6_url_filter", "op10_secret_scan"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    before, done = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        done[name] = {r.doc_id: r.text for r in after.collect()}
        before = after
    clean = done["toxicity"]
    assert set(clean) <= set(texts) and all(clean[d] == texts[d] for d in clean)
    assert len(set(texts) - set(clean) - toxic) <= 0.02 * len(texts) + len(texts) * 0.1  # unlabelled toxic ones go too
    lines = done["line_dedup"]
    assert set(lines) == set(clean)
    assert all(set(lines[d].split("\n")) <= set(clean[d].split("\n")) for d in lines)
    smallest = {d for d, (_, group) in brute.groups(lines.items(), percent=80, size=5).items() if d == group}
    assert set(done["jaccard_join"]) == smallest
    bench = [brute.words(re.sub("[^0-9A-Za-z\x80-\U0010ffff]", " ", r.text), fold=True) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for d, text in done["jaccard_join"].items():
        w = brute.words(re.sub("[^0-9A-Za-z\x80-\U0010ffff]", " ", text), fold=True)
        whole = any(w[i : i + len(b)] == b for b in bench for i in range(len(w) - len(b) + 1))
        assert not (whole and d in done["decontamination"])
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    assert {r.doc_id: r.decoded for r in last} == done["decontamination"]
    assert all(r.n_tokens == len(r.ids) for r in last)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 0 < out.count() < 200
