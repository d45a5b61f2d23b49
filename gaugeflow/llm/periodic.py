"""Periodic runs of words: maximal stretches that repeat a period, found from Lyndon words.

By the runs theorem (Bannai et al., 2017) every run of period q holds, under an order of the words or
under its reverse, a position whose longest Lyndon word has q words and begins no more than q words
after the run does. A text is scanned from right to left with a stack of next smaller suffixes, once
for each order; each position's longest Lyndon word reaches to its next smaller suffix. Suffixes are
compared, and runs extended to both sides, by their longest common extension: a few words directly,
then by binary search on rolling hashes. Every run that is returned has been compared word by word;
should hashes have misled, the text is scanned again without them.

A text is the work of one Python worker and of nothing else: one pass over the documents, no shuffle.

Null and blank texts have no words: no runs, the digests of the empty string. A null doc_id stays null
and its text is not edited by ``spread_periods``. Equal rows give equal results, each its own row; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words, and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that are compared one by one before hashes are asked.
DIRECT = 8
#: Rolling hashes are taken modulo this prime, to this base.
PRIME = (1 << 61) - 1
BASE = 1_104_637_801_253_377_231

Run = tuple[int, int, int]


class Extension:
    """Longest common extensions of positions of ``ids`` to the right and to the left."""

    def __init__(self, ids: Sequence[int], hashed: bool = True) -> None:
        self.ids, self.n, self.hashed = ids, len(ids), hashed
        self.sums: list[int] | None = None

    def _prepare(self) -> None:
        self.sums = list(accumulate(self.ids, lambda h, x: (h * BASE + x + 1) % PRIME, initial=0))
        self.powers = list(accumulate(range(self.n), lambda h, _: h * BASE % PRIME, initial=1))

    def _longest(self, i: int, j: int, most: int, step: int) -> int:
        """The largest length up to ``most`` at which both stretches have one hash: doubled, then halved. i < j; step -1 looks to the left of both."""
        if self.sums is None:
            self._prepare()
        sums, powers = self.sums, self.powers
        low, reach = 0, 16
        high = most + 1
        while low < most:
            size = min(low + reach, most)
            a, b = (i + low, i + size) if step > 0 else (i - size, i - low)
            c, d = (j + low, j + size) if step > 0 else (j - size, j - low)
            power = powers[size - low]
            if (sums[b] - sums[a] * power - sums[d] + sums[c] * power) % PRIME:
                high = size
                break
            low, reach = size, reach * 2
        while high - low > 1:
            size = (low + high) // 2
            a, b = (i + low, i + size) if step > 0 else (i - size, i - low)
            c, d = (j + low, j + size) if step > 0 else (j - size, j - low)
            power = powers[size - low]
            if (sums[b] - sums[a] * power - sums[d] + sums[c] * power) % PRIME:
                high = size
            else:
                low = size
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        ids, most, k = self.ids, self.n - j, 0
        near = min(most, DIRECT) if self.hashed else most
        while k < near and ids[i + k] == ids[j + k]:
            k += 1
        return k if k < near or k == most else k + self._longest(i + k, j + k, most - k, 1)

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j)."""
        ids, k = self.ids, 0
        near = min(i, DIRECT) if self.hashed else i
        while k < near and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
        return k if k < near or k == i else k + self._longest(i - k, j - k, i - k, -1)


def _scan(ids: list[int], sign: int, extension: Extension, found: dict[int, Run]) -> None:
    """Adds the runs whose Lyndon words are those of the order of ids (sign 1) or of its reverse (-1).

    ``smaller[i]`` is the next smaller suffix of i: the stack is the chain i, smaller[i], smaller[smaller[i]], ...
    A suffix that is a prefix of another is the smaller one.
    """
    n = len(ids)
    keys = [x if sign > 0 else -x for x in ids]
    keys.append(min(keys, default=0) - 1)  # the end is smaller than every word
    smaller = [n] * n
    right = extension.right
    latest: dict[int, int] = {}
    for i in range(n - 2, -1, -1):
        a, j = keys[i], i + 1
        while True:
            b = keys[j]
            if a > b:
                break
            if a < b:
                j = smaller[j]
                continue
            a1, b1 = keys[i + 1], keys[j + 1]
            if a1 > b1:
                break
            if a1 < b1:
                j = smaller[j]
                continue
            same = right(i, j)
            if keys[i + same] < keys[j + same]:
                j = smaller[j]
                continue
            period = j - i
            # the first of the run's Lyndon words begins within a period of its start, so two more periods at least follow the word and its repeat
            if same >= (LEAST_PERIODS - 2) * period and latest.get(period, n) > i:
                start = i - extension.left(i, j)
                length = j + same - start
                if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    found[start, period] = (start, length, period)
                latest[period] = start  # further words of the same run need no look
            break
        smaller[i] = j


def runs(ids: list[int]) -> list[Run]:
    """(start, length, period) of every maximal run of at least LEAST_WORDS words and LEAST_PERIODS periods, by start, then period."""
    for hashed in (True, False):
        found: dict[int, Run] = {}
        extension = Extension(ids, hashed)
        for sign in (1, -1):
            _scan(ids, sign, extension, found)
        if all(_is_run(ids, *run) for run in found.values()):
            break
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def _is_run(ids: list[int], start: int, length: int, period: int) -> bool:
    """Word by word: the stretch has the period and no neighbour keeps it."""
    end = start + length
    if any(map(int.__ne__, ids[start : end - period], ids[start + period : end])):
        return False
    return (start == 0 or ids[start - 1] != ids[start - 1 + period]) and (end == len(ids) or ids[end] != ids[end - period])


def kept_words(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not found:
        return words
    out, reach = [], 0
    drops = sorted((start + period, start + length) for start, length, period in found)
    for low, high in drops:
        if low > reach:
            out += words[reach:low]
        reach = max(reach, high)
    return out + words[reach:]


def spread_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with its end made periodic, as its doc_id says."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    times = -(-(n - start) // period)
    return words[:start] + (words[start : start + period] * times)[: n - start]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, doc_id "
#: Characters of collapsed text after which a worker hands its rows on.
FLUSH = 8 << 20


def _worker(edit: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ids = batch.column("doc_id")
        first, size, rows = 0, 0, []
        for k in range(batch.num_rows):
            words = (texts[k].as_py() or b"").split()
            if edit:
                words = spread_period(ids[k].as_py(), words)
            number: dict[bytes, int] = {}
            found = runs([number.setdefault(w, len(number)) for w in words])
            collapsed = b" ".join(kept_words(words, found))
            rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in found], collapsed))
            size += len(collapsed)
            if size >= FLUSH or k == batch.num_rows - 1:
                counts, all_runs, all_texts = zip(*rows)
                columns = [pa.array(counts, pa.int64()), pa.array(all_runs, _RUNS), pa.array(all_texts, pa.binary()).cast(pa.string()), ids.slice(first, len(rows))]
                yield pa.RecordBatch.from_arrays(columns, ["n_words", "runs", "collapsed", "doc_id"])
                first, size, rows = k + 1, 0, []


def find(docs: DataFrame, edit: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each document: every run, and the text without the words that runs repeat, one space between two words.

    ``edit`` makes the ends of one text in ten periodic first (``spread_period``), which gives corpora without runs some.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(lambda batches: _worker(edit, batches), _OUT + kind)
    return out.select("doc_id", "n_words", "runs", "collapsed")


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: number of runs, the run of greatest exponent (ties: smallest start, then period) and digests of the runs and of the collapsed text."""

    def stronger(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (
            F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
            .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
        )

    best = F.try_element_at(F.array_sort("runs", stronger), F.lit(1))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = find(docs, edit=True).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
