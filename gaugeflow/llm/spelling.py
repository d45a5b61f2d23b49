"""Spelling variants: words that one edit separates, grouped under the most frequent.

Words meet by an even-partition pigeonhole join. A word of length L is cut into two segments whose
lengths depend on L alone; one edit touches one segment at most, so the other stands unchanged in the
near word: at its own place, or, behind an inserted letter, one place further. Each word is indexed
under its two segments and probes the segments of words as long as itself or one letter shorter.
Candidates that meet twice count once, and each is verified.

A segment that very many words share (a common prefix) is cut on: words that agree in it can differ in
the other segment only, which is halved by the same rule, and so on until a letter is left. Pairs are
thus looked for only among words that agree in enough letters, whatever the vocabulary looks like.

Words are counted in Spark with a partial sum per task, so a word that is a third of all words costs
no task more than another. Every text is read whole. Null and blank texts have no words; a null doc_id
is taken as the empty string; equal rows count each; empty tables give empty ones; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import stash

#: Letters of words, after A to Z are lower-cased.
LETTERS = r"a-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form has this many times its variant's occurrences.
FORM_RATIO = 5
#: One run in so many loses a letter (``runs_of``).
EDIT_ONE_IN = 199
#: Pairs that a segment may bring together before it is cut on.
MOST_PAIRS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of(docs: DataFrame, edit: bool = False) -> DataFrame:
    """(word) of every maximal run of letters in ``docs`` (doc_id, text), A to Z in lower case.

    ``edit`` takes a letter from one run in ``EDIT_ONE_IN``, chosen by the checksum of doc_id and run, which gives clean corpora some variants.
    Runs under LEAST_LETTERS are left out: with a letter less they are shorter still.
    """
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    if edit:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = words.select(F.when(h % EDIT_ONE_IN == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.select("word").where(F.length("word") >= LEAST_LETTERS)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words that occur often enough."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _half(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2).cast("int")


def _keys(rows: DataFrame) -> DataFrame:
    """Cuts the open part [a, b) of each row in two and keys both halves.

    A row (word, size, a, b) stands for words of ``size`` letters that agree with ``word`` outside their letters a to b - 1;
    where ``word`` has a letter more, its open part reaches to b. ``key`` hashes the place of the open part and all letters outside it.
    """
    middle = _half(F.col("a"), F.col("b"))
    parts = F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b")))
    cut = rows.select("word", "size", F.explode(parts).alias("part")).select("word", "size", "part.a", "part.b")
    longer = F.length("word") - F.col("size")
    head = F.substring(F.col("word"), F.lit(1), F.col("a"))
    tail = F.substring(F.col("word"), F.col("b") + longer + 1, F.length("word"))
    return cut.withColumn("key", F.xxhash64("size", "a", "b", head, tail))


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a, b): every two of the distinct ``words`` (word) that one inserted, deleted or replaced letter separates, once, the shorter (or smaller) first."""
    sizes = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", F.explode(sizes).alias("size")).where(F.col("size") > 0).withColumns({"a": F.lit(0), "b": F.col("size")})
    found = None
    while True:
        keyed = stash(_keys(rows), "segments")
        shorter = F.length("word") == F.col("size")
        groups = keyed.groupBy("key").agg(F.count_if(shorter).alias("left"), F.count("*").alias("all")).where((F.col("left") > 0) & (F.col("all") > 1))
        # an open part of one letter can't be cut; so few words agree in all others that they are compared at once
        dense = (F.col("left") * F.col("all") > most_pairs) & (F.col("b") - F.col("a") > 1)
        grouped = stash(keyed.join(groups, "key").withColumn("dense", dense), "groups")
        sparse = grouped.where(~F.col("dense"))
        left = sparse.where(shorter).select("key", F.col("word").alias("a"))
        right = sparse.select("key", F.col("word").alias("b"))
        ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        candidates = left.join(right, "key").where(ordered).select("a", "b")
        found = candidates if found is None else found.unionByName(candidates)
        rows = grouped.where("dense").select("word", "size", "a", "b")
        if rows.isEmpty():
            break
    return found.distinct().where(F.levenshtein(F.col("a"), F.col("b"), 1) == 1)


def forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if it has ``ratio`` times the word's n, ``root``
    where following forms ends. Each form is ``ratio`` times as frequent as its variant, so chains are logarithmic; ways are
    doubled until none grows.
    """
    words = stash(words, "words")
    pairs = near_pairs(words.select("word"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    out = stash(
        joined.select(
            "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    ways = stash(out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ways.join(onward, "root", "left_semi").isEmpty():
            break
        ways = stash(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ways")
    return out.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, edit: bool = False) -> DataFrame:
    """``forms`` of the words of ``docs``."""
    return forms(vocabulary(runs_of(docs, edit)))
