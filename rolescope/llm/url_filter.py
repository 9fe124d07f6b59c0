"""URL filter: a sorted array of 64-bit digests, searched with vectorised binary search.

A rule is a host and the beginning of a path, such as ``example.net/en/``; it fits its host
and all subdomains. The rules' xxhash64 digests lie sorted in a file that tasks map into
memory, with the rules as text beside them. A URL is looked up by every suffix of its host
and every length that a rule's path has; a digest found counts only if the stored text is
the same, so colliding digests do no harm.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one array; longer lists are looked up array by array.
ARRAY_RULES = 1 << 20
SEED = 42  # of Spark's xxhash64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class DigestArray:
    """Sorted digests, rule texts and verdicts in a memory-mapped file."""

    def __init__(self, path: Path):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(data[:8].view(np.int64)[0])
        self.digests = data[8 : 8 + 8 * n].view(np.uint64)
        at = 8 + 8 * n
        self.offsets = data[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.block, self.texts = data[at : at + n], data[at + n :]

    @staticmethod
    def pack(rules: list[tuple[str, bool]]) -> bytes:
        """File content for (rule, block or not)."""
        coded = [r.encode() for r, _ in rules]
        digests = np.array([xxhash.xxh64_intdigest(r, SEED) for r in coded], dtype=np.uint64)
        order = np.argsort(digests, kind="stable")
        ends = np.cumsum([0] + [len(coded[i]) for i in order])
        verdicts = np.array([rules[i][1] for i in order], dtype=np.uint8)
        parts = (np.array([len(rules)]), digests[order], ends, verdicts)
        return b"".join(p.tobytes() for p in parts) + b"".join(coded[i] for i in order)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule number of each key, or -1."""
        wanted = np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1, dtype=np.int64)
        todo = np.flatnonzero(at < len(self.digests))
        while len(todo):  # digests alike follow each other
            todo = todo[self.digests[at[todo]] == wanted[todo]]
            for i in todo:
                a = at[i]
                if self.texts[self.offsets[a] : self.offsets[a + 1]].tobytes() == keys[i]:
                    found[i] = a
            todo = todo[found[todo] < 0]
            at[todo] += 1
            todo = todo[at[todo] < len(self.digests)]
        return found


def _candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Every rule that would fit, longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    out = [h + path[:n] for h in hosts for n in lengths if n <= len(path)]
    return [x.encode() for x in sorted(out, key=len, reverse=True)]


def _look_up(rows: DataFrame, content: bytes, lengths: list[int]) -> DataFrame:
    """Takes the array's rule where it is longer than the one so far."""
    sent = rows.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            file = Path(folder, "rules.bin")
            file.write_bytes(sent.value)
            array = DigestArray(file)
            for batch in batches:
                keys, first = [], [0]
                for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True):
                    keys += _candidates(host, path, lengths)
                    first.append(len(keys))
                found = array.find(keys)
                rules, verdicts = batch["rule"].to_pylist(), batch["verdict"].to_pylist()
                for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
                    hits = np.flatnonzero(found[a:b] >= 0)
                    if len(hits):
                        rule = keys[a + hits[0]].decode()
                        if rules[i] is None or len(rule) > len(rules[i]):
                            rules[i], verdicts[i] = rule, "block" if array.block[found[a + hits[0]]] else "allow"
                at = {"rule": rules, "verdict": verdicts}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[c], pa.string()) if c in at else batch[c] for c in batch.schema.names],
                    names=batch.schema.names,
                )

    return rows.mapInArrow(run, rows.schema)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", array_rules: int = ARRAY_RULES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (the longest rule's, else ``default``).

    ``rules``: columns rule, verdict (block or allow). Of equally long rules that fit, the one
    with the longer host wins; of a rule given twice, block wins; null rules are left out.
    Every page row is judged by itself, null or repeated as it may be; an empty list leaves
    all to ``default``. The driver holds one array of at most ``array_rules`` rules at a time.
    """
    host, path = host_and_path(F.col("url"))
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), none.alias("rule"), none.alias("verdict"))
    listed = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    arrays = listed.count() // array_rules + 1
    part = F.pmod(F.shiftright(F.xxhash64("rule"), 16), F.lit(arrays))
    for i in range(arrays):
        mine = [(r.rule, r.verdict == "block") for r in listed.where(part == i).collect()]
        lengths = sorted({len(r) - (r + "/").index("/") for r, _ in mine})
        if mine:
            rows = _look_up(rows, DigestArray.pack(mine), lengths)
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
