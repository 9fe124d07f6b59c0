"""Secret scan: candidates by form, false positives removed by a random forest.

A candidate is a run of at least 16 characters of ``[A-Za-z0-9_+/-]`` with a digit in it;
a word between blanks may hold several, and each is judged by itself.
The forest judges it by its length, the changes between kinds of characters, how much of it
common words cover, whether it is part of a path, and the words around it. It is trained on
labelled findings. All features are Spark expressions, the forest is Spark's own.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .quality import word_list
from .store import stored

#: A whole run, from its first character on, that has a digit.
RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}"
# Words that stand beside secrets, and beside numbers and digests that are none.
SECRET_WORDS = r"(?i)token|secret|passw|pwd|api.?key|access.?key|credential|bearer|auth"
OTHER_WORDS = r"(?i)commit|sha-?[0-9]|md5|hash|digest|uuid|card|order|invoice|account|phone|iban|version"
# Common parts of names and paths.
COMMON = (
    "about access account admin after archive article assets author backup before build cache client cloud code "
    "commit common config content data date debug default demo detail document download draft error event example "
    "file final folder forum group guide help home html image index info item latest library list local login mail "
    "main media member message module name news note number object order page part photo post press product profile "
    "project public query release report sample search server service session setting share site source start state "
    "static storage story style system table team temp test text theme time title topic update upload user value "
    "version video view week work world year"
).split()
#: Findings the forest is fitted on, at most.
SAMPLE = 20_000
FEATURES = (
    "length digits upper lower distinct changes coverage hex path slashes named other assigned quoted after_word"
).split()


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, place (number of the word), nth (of the word's candidates, from 0), candidate, before, after: a row a candidate.

    ``before`` reaches back over two words or, in the same word, to the beginning of the
    candidate before; ``after`` to the end of the next word or candidate. So the rows of a
    word with very many candidates stay as long as the word, not as long as its square.
    """

    def found(words: Column) -> Column:
        places = F.filter(
            F.transform(words, lambda w, i: F.when((F.length(w) >= 16) & w.rlike("[0-9]") & w.rlike(RUN), i)),
            lambda i: i.isNotNull(),
        )
        return F.transform(
            places,
            lambda i: F.struct(
                i.alias("place"),
                F.get(words, i).alias("word"),
                F.concat_ws(" ", F.get(words, F.greatest(i - 2, F.lit(-1))), F.get(words, i - 1)).alias("lead"),
                F.coalesce(F.get(words, i + 1), F.lit("")).alias("next"),
            ),
        )

    def parts(word: Column) -> Column:
        return F.struct(
            F.regexp_extract_all(word, F.lit(RUN), F.lit(0)).alias("runs"), F.split(word, RUN, -1).alias("gaps")
        )

    def judged(p: Column) -> Column:
        runs, gaps = p["runs"], p["gaps"]
        return F.transform(
            runs,
            lambda run, i: F.struct(
                i.alias("nth"),
                run.alias("candidate"),
                F.concat(
                    F.when(i == 0, F.concat("lead", F.lit(" "))).otherwise(F.get(runs, i - 1)), F.get(gaps, i)
                ).alias("before"),
                F.concat(
                    F.get(gaps, i + 1),
                    F.when(i == F.size(runs) - 1, F.concat(F.lit(" "), F.col("next"))).otherwise(F.get(runs, i + 1)),
                ).alias("after"),
            ),
        )

    rows = docs.select("doc_id", F.explode(let(word_list(F.col("text")), found)).alias("f")).select("doc_id", "f.*")
    rows = rows.select("doc_id", "place", F.explode(let(parts(F.col("word")), judged)).alias("c"))
    return rows.select("doc_id", "place", "c.*")


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` of candidate, before, after, with the forest's features; a null counts as empty."""
    c, before, after = (F.coalesce(x, F.lit("")) for x in ("candidate", "before", "after"))
    size = F.greatest(F.length(c), F.lit(1))
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/-])(?=[^_+/-])"
    uncovered = F.regexp_replace(F.lower(c), "|".join(COMMON), "")
    flag = lambda test: test.cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    return rows.withColumns(
        {
            "length": size.cast("double"),
            "digits": count("[0-9]") / size,
            "upper": count("[A-Z]") / size,
            "lower": count("[a-z]") / size,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
            "changes": count(changes) / size,
            "coverage": 1 - F.length(uncovered) / size,
            "hex": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
            "path": flag(before.rlike(r"://|www\.|[/\\]$") | after.rlike(r"^[/.][A-Za-z]")),
            "slashes": count("/").cast("double"),
            "named": flag(before.rlike(SECRET_WORDS)),
            "other": flag(before.rlike(OTHER_WORDS)),
            "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
            "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "after_word": flag(after.rlike(r"^\W*\s*[a-z]")),
        }
    )


def scan(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 6) -> DataFrame:
    """One row per candidate: doc_id, place, nth, candidate, probability, secret (at least one half).

    ``labelled``: candidate, before, after, label (1 secret, 0 not); at most ``sample`` rows,
    evenly drawn by a hash, train the forest. Without labels of both kinds nothing can be told
    to be false: every candidate is reported with probability 1. Null texts have no
    candidates; repeated rows and null doc_ids are scanned like any others.
    """
    rows = with_features(findings(docs))
    known = labelled.where("label is not null and candidate is not null").select("candidate", "before", "after", "label")
    known = known.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after", "label").limit(sample)
    known = stored(known, "secret-labels")
    kept = ["doc_id", "place", "nth", "candidate"]
    if known.select("label").distinct().count() < 2:
        return rows.select(*kept, F.lit(1.0).alias("probability"), F.lit(True).alias("secret"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8
    )
    prepared = vectors.transform(with_features(known)).select("features", F.col("label").cast("double").alias("label"))
    model = forest.fit(prepared)
    judged = model.transform(vectors.transform(rows))
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return judged.select(*kept, chance.alias("probability")).withColumn("secret", F.col("probability") >= 0.5)


def known_forms(found: DataFrame) -> DataFrame:
    """Findings labelled by forms that leave no doubt; the others stay out.

    Access-key ids and quoted or assigned values beside a secret word are secrets. Numbers
    of digits only and digests beside a word for digests are not.
    """
    c, before = F.col("candidate"), F.col("before")
    key = c.rlike("^AKIA[A-Z0-9]{16}$")
    value = before.rlike(rf"({SECRET_WORDS})[A-Za-z_]*[\"']?\s*[=:]\s*[\"']?$")
    none = c.rlike("^[0-9-]+$") | (before.rlike(OTHER_WORDS) & ~before.rlike(SECRET_WORDS))
    label = F.when(key | value, 1).when(none, 0)
    return found.select("candidate", "before", "after", label.alias("label")).where("label is not null")
