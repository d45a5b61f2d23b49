"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

Every five-word shingle of a text is hashed to 48 bits; the sketch keeps each hash below a fixed
fraction (``FRACTION``) of the hash space, and always the smallest hash, so that no text with words
has an empty sketch. The sketch of a union is the merge of the sketches, and as the kept share is the same
for every text, the overlap of two sketches estimates containment even between very unequal texts.

Words are lower-cased and parted by white space; fewer than five words make one shingle. Null and
empty texts have an empty sketch: two of them are alike (1.0), one and a text with words are not (0.0).
The order of documents is by descending doc_id, null ids last, ties by text; rows that repeat an id
or a whole row are documents each. Empty input gives empty output, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import SPACE, n_partitions, text_or_empty

SHINGLE = 5
HASH_BITS = 48
FRACTION = 8


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it within a lambda."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    mask = F.lit((1 << HASH_BITS) - 1)
    return F.transform(bind(F.transform(words, lambda w: F.xxhash64(w)), of), lambda v: v.bitwiseAND(mask))


def sketch(text: Column, fraction: int = FRACTION, n: int = SHINGLE) -> Column:
    """Sorted array of the kept hashes."""
    limit = F.lit((1 << HASH_BITS) // fraction)
    return bind(shingle_hashes(text, n), lambda v: F.array_sort(F.array_distinct(F.concat(F.filter(v, lambda x: x < limit), F.array_compact(F.array(F.array_min(v)))))))


def merge(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of two texts' shingles taken together."""
    limit = F.lit((1 << HASH_BITS) // fraction)
    return bind(F.array_union(a, b), lambda v: F.array_sort(F.filter(v, lambda x: (x < limit) | (x == F.array_min(v)))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    return bind(both, lambda x: F.coalesce(F.try_divide(x, F.size(a) + F.size(b) - x), F.lit(1.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(1.0))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda v: F.lpad(F.lower(F.hex(v)), HASH_BITS // 4, "0")), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each of ``columns``: those of the next document in descending doc_id, the first after the last.

    Ranges of doc_id are cut at quantiles (ids of the table). The largest row of each range is also dealt to the
    range above it, and the largest of all to the lowest, so that every row meets its successor in one shuffle.
    """
    n = 2 * n_partitions(docs.sparkSession)
    found = docs.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] if n > 1 else [0.5], 10_000), F.max("doc_id")).first()
    largest = found[1]
    at = sorted({c for c in found[0] or [] if c < largest})
    known = F.array(*[F.lit(c).cast("long") for c in at]) if at else F.array().cast("array<bigint>")
    order = F.coalesce(F.size(F.filter(known, lambda c: c < F.col("doc_id"))), F.lit(0))
    place = lambda part, copied: F.struct(part.cast("int").alias("part"), F.lit(copied).alias("copied"))
    above = F.when(F.array_contains(known, F.col("doc_id")), place(order + 1, 1))
    wrapped = F.when(F.col("doc_id") == F.lit(largest).cast("long"), place(F.lit(0), 2))
    dealt = docs.withColumn("__at", F.explode(F.array_compact(F.array(place(F.greatest(order, F.lit(0)), 0), above, wrapped))))
    window = Window.partitionBy("__at.part").orderBy((F.col("__at.copied") == 2).asc(), F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = dealt
    if largest is None:  # no ids at all: one range, whose last row is followed by its first
        return out.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(window), F.first(c).over(whole)) for c in columns}).drop("__at")
    return out.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where(F.col("__at.copied") == 0).drop("__at")


def edit(text: Column, other: Column) -> Column:
    """``text`` with its last half (code points) replaced by as many of the first of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, fraction: int = FRACTION) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("sketch", sketch(F.col("text"), fraction))
    rows = with_next(base, ["text", "sketch"])
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edit(F.col("text"), F.col("next_text")).alias("edited"), "sketch", "next_sketch")
    rows = rows.select("*", sketch(F.col("edited"), fraction).alias("edited_sketch"))
    s, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(s).alias("fingerprint"), as_string(e).alias("edited_fingerprint"),
        likeness(s, e).alias("near_edited"), likeness(s, n).alias("near_next"), containment(s, e).alias("contained_in_edited"),
    )
