"""Drops lines whose template recurs across documents.

Lines are parsed as in a fixed-depth template tree. The first level is the number of
tokens, the next levels the leading tokens; tokens with a digit count as variable fields.
Below that path a line generalises to a few templates: the line as it is, and the line with
one of ``spans`` equal stretches of its tokens left open; a line too short for stretches, with
one token below the path left open. Two lines of one path that agree outside one stretch or
token share a template, whatever fields vary inside it.

A template that ``min_docs`` different texts or more hold is boilerplate. Very short lines
and ones with an open token say less, so they take ``weak_docs`` texts. The first of the
texts (by doc_id) keeps its lines; the others lose them. Templates travel as hashes and are
counted before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .columns import numbered, pick
from .quality import word_list
from .store import stored

VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _stretches(tokens: Column, depth: int, spans: int) -> list[Column]:
    """Hashes of equal stretches of the tokens below the path."""
    free = F.greatest(F.size(tokens) - depth, F.lit(0))
    ends = [depth + F.floor(free * i / spans).cast("int") for i in range(spans + 1)]
    return [F.xxhash64(F.slice(tokens, a + 1, b - a)) for a, b in zip(ends, ends[1:], strict=False)]


def _exclusive_or(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda done, x: done.bitwiseXOR(x))


def template_uses(docs: DataFrame, depth: int, spans: int, min_tokens: int, least_tokens: int) -> DataFrame:
    """A row for each template (path and rest, hashed) of each line with a word: doc_id, text_hash, line (from 0).

    The lowest bit of a template says that it is weak. In lines of more than ``least_tokens``
    and less than ``min_tokens`` every token is hashed once with its place; what is left when one
    is opened is the exclusive or of the others.
    """
    lines = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "words")
    )
    words = F.when(F.col("words").rlike("[0-9]"), F.regexp_replace("words", VARIABLE, "<*>")).otherwise(F.col("words"))
    tokens = word_list(words)
    # of a few variable tokens and nothing else no text would be left: they are compared as they are
    bare = (F.size(tokens) < least_tokens) & (F.size(F.array_remove(tokens, "<*>")) == 0)
    tokens = F.when(bare, word_list(F.col("words"))).otherwise(tokens)
    tokens = lines.select("doc_id", "text_hash", "line", tokens.alias("tokens")).where(F.size("tokens") > 0)
    lead = [F.get("tokens", F.lit(i)) for i in range(depth)]
    names = [f"s{i}" for i in range(spans)]
    n = F.size("tokens")
    # nothing but variable fields outside the open token says nothing
    several = F.size(F.array_remove(F.slice("tokens", 1, min_tokens), "<*>")) > 1
    medium = (n > least_tokens) & (n < min_tokens) & several
    parsed = tokens.select(
        "doc_id",
        "text_hash",
        "line",
        n.alias("n"),
        F.xxhash64(n, *lead).alias("path"),
        *[s.alias(name) for s, name in zip(_stretches(F.col("tokens"), depth, spans), names, strict=True)],
        F.when(medium, F.transform("tokens", lambda t, i: F.xxhash64(t, i))).alias("marks"),
    )
    whole = F.xxhash64("path", F.lit(-1), *names)
    open_ = [F.xxhash64("path", F.lit(i), *[x for x in names if x != name]) for i, name in enumerate(names)]
    # a short line has too little outside a stretch
    rests = F.when(F.col("n") >= min_tokens, F.array(whole, *open_)).otherwise(F.array(whole))
    even, odd = F.lit(-2).cast("long"), F.lit(1).cast("long")
    weak = (F.col("n") < least_tokens).cast("long")
    rests = F.transform(rests, lambda x: x.bitwiseAND(even) + weak)

    def opened(all_: Column) -> Column:
        others = F.transform("marks", lambda x, i: F.xxhash64("path", i + spans, all_.bitwiseXOR(x)).bitwiseOR(odd))
        return F.slice(others, depth + 1, min_tokens)

    ones = let(_exclusive_or(F.col("marks")), opened)
    templates = F.when(F.col("marks").isNull(), rests).otherwise(F.concat(rests, ones))
    return parsed.select("doc_id", "text_hash", "line", F.explode(templates).alias("template"))


def drop_recurring(
    docs: DataFrame,
    min_docs: int = 3,
    depth: int = 2,
    spans: int = 4,
    min_tokens: int = 12,
    least_tokens: int = 4,
    weak_docs: int = 10,
) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and n_lines, dropped (their numbers).

    Documents with one and the same text count as one and lose the same lines. Lines with
    fewer than ``least_tokens`` tokens recur when ``weak_docs`` texts hold them. Longer ones of
    fewer than ``min_tokens`` also recur when ``weak_docs`` texts hold them with one token changed,
    always the same one, below the path. Blank lines always stay. The lines that stay keep their
    order, white space and line breaks. A null text stays null, and a row with a null doc_id
    stays as it is. Columns of ``docs`` named n_lines or dropped, in upper or lower case, are
    replaced; all others stay, whatever their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "dropped")]
    docs = pick(docs, *kept)
    docs, names = numbered(docs, "doc_id", "text")
    uses = stored(template_uses(docs, depth, spans, min_tokens, least_tokens), "line-templates")
    texts = uses.groupBy("template", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    wide = texts.groupBy("template").agg(
        F.count("*").alias("texts"), F.min(F.struct("doc_id", "text_hash")).alias("first")
    )
    weak = F.col("template").bitwiseAND(F.lit(1).cast("long")) == 1
    enough = F.when(weak, max(min_docs, weak_docs)).otherwise(min_docs)
    wide = wide.where(F.col("texts") >= enough).select("template", F.col("first.text_hash").alias("first"))
    gone = uses.select("text_hash", "line", "template").join(wide, "template").where("text_hash <> first")
    gone = gone.groupBy("text_hash").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    hashed = docs.select("*", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).alias("text_hash"))
    joined = hashed.join(gone, "text_hash", "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
    return out.toDF(*names, "n_lines", "dropped")
