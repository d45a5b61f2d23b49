"""License scans by patience alignment.

A licence text is aligned with a part of a document: words that occur once in both are anchors, the
longest increasing run of them (in both orders) is kept, and the gaps between kept anchors are aligned
the same way; a gap without anchors keeps what agrees at its ends. The coverage is the share of the template's
words that are matched. A document is scanned where it holds words of a template that any match must
hold: so many of the template's words that a match of the least coverage can't do without all of them.
Each such word says where the template would start; it is aligned with the words there, and where those don't match, with a wider part.

Coverage alone would take a licence for its neighbour, from which a word may tell it. So a match must also hold its template's
version numbers, its names (``NAMES``) and its qualifiers (``QUALIFIERS``), and no qualifier of another licence between its words.
A notice of a version or variant without a template is thus not reported, instead of under a neighbour's name.

``scan`` gives a row for every match (doc_id, license, template, coverage,
place of the match in words), several of a template too; of matches that overlap, the one that covers
most words stays. The bodies of long licences are known by the notices that they hold. Words are lower-cased runs of ASCII letters and digits and of other
alphabets' bytes. Null and empty texts match nothing; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.license_texts import NAMES, QUALIFIERS, TEMPLATES
from gaugeflow.llm.textgrid import Words, slices

LEAST_COVERAGE = 0.8
#: All bytes but letters, digits and those of other alphabets part words.
SEPARATORS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def words_of(text: str) -> np.ndarray:
    return Words(pa.array([text]), SEPARATORS).hashes


def increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles as in patience sorting."""
    tops: list[int] = []
    held: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(held[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            held.append(i)
        else:
            tops[at], held[at] = v, i
    out, i = [], held[-1] if held else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        out += kept
        if kept:
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def must_have(words: list, least: float) -> set:
    """Words of which a match of coverage ``least`` holds one at least: the rarest, more than the share that may be missing."""
    count, out, n = Counter(words), set(), 0
    for w in sorted(count, key=lambda w: (RANK.get(w, 0), count[w], w)):
        out.add(w)
        n += count[w]
        if n > (1 - least) * len(words):
            break
    return out


def _rank(templates) -> dict:
    """How many templates hold a word."""
    return Counter(w for _, text in templates for w in set(words_of(text).tolist()))


RANK: dict = _rank(TEMPLATES)


def windows(start: int, n: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Where to align a template of ``n`` words that seems to start at ``start``: right there, closely around it, then with room for words that were put in."""
    for room in (0, max(2, n // 5), max(4, 3 * n // 4)):
        yield max(low, start - room), min(high, start + n + room)


def deciding(text: str) -> tuple[list[set[int]], set]:
    """What a match of a template must hold (a place of each of these sets), and the words that it may not have between its own."""
    words = [w for w in re.split("[^0-9a-z]+", text.lower()) if w]
    held = [{i for i, w in enumerate(words) if w == name} for name in dict.fromkeys(words) if name in QUALIFIERS or name in NAMES]
    version = False
    for i, w in enumerate(words):
        # all numbers of a short notice; of a longer one those of its version, not those of addresses
        version = w.isdigit() and (len(words) <= 20 or words[i - 1] in ("version", "v") or version and words[i - 1].isdigit())
        held += [{i}] * version
    return held, {h for q in QUALIFIERS if q not in words for h in words_of(q).tolist()}


def matches_of(template: list, places: dict, must: set, words: list, hits: list[int], least: float, held: Sequence[set[int]] = (), barred: Container = ()) -> list[tuple[int, int, int]]:
    """(matched words, start, end) of all matches of a template in a text, in order; matches don't overlap.

    ``places`` has the template's places of each word. Every word of ``hits`` that a match must have says where the template
    would start; what is near is aligned there, unless too few of the template's words are. Copies that follow each other are found each,
    since a window holds little more than one. ``held`` and ``barred`` are what ``deciding`` gives.
    """
    n, found, low, tried = len(template), [], 0, set()
    for i in hits:
        if i < low or words[i] not in must:
            continue
        for q in places[words[i]]:
            start = i - q
            if start in tried or i < low:
                continue
            tried.add(start)
            for a, b in windows(start, n, low, len(words)):
                if sum(w in places for w in words[a:b]) < least * n:
                    continue
                pairs = patience(template, words[a:b])
                if len(pairs) >= least * n and pairs[-1][1] - pairs[0][1] + 1 <= 1.5 * n + 2:
                    matched = {i for i, _ in pairs}
                    if not all(matched & some for some in held) or any(w in barred for w in words[a + pairs[0][1] : a + pairs[-1][1] + 1]):
                        continue
                    found.append((len(pairs), a + pairs[0][1], a + pairs[-1][1] + 1))
                    low = found[-1][2]
                    break
    return found


def _scan(templates: Sequence[tuple[str, str]], least: float):
    prepared = [(n, name, words_of(text).tolist(), deciding(text)) for n, (name, text) in enumerate(templates)]
    needed = [(n, name, words, {w: [q for q, x in enumerate(words) if x == w] for w in words}, must_have(words, least), tells) for n, name, words, tells in prepared]
    every = np.array(sorted({w for *_, s, _ in needed for w in s}), np.uint64)

    def matches(words: list, hits: list[int]) -> list[tuple]:
        found = []
        for n, name, template, places, must, (held, barred) in needed:
            found += [(m, -n, name, m / len(template), a, b) for m, a, b in matches_of(template, places, must, words, hits, least, held, barred)]
        kept: list[tuple] = []
        for m in sorted(found, reverse=True):
            if all(m[5] <= k[4] or m[4] >= k[5] for k in kept):
                kept.append(m)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(batch.schema.get_field_index("doc_id")), []
            for start, part in slices(batch.column(batch.schema.get_field_index("text"))):
                words = Words(part, SEPARATORS)
                hits = np.flatnonzero(np.isin(words.hashes, every))
                rows = words.row[hits]
                for row in np.unique(rows):
                    first = words.first[row]
                    own = words.hashes[first : words.first[row + 1]]
                    for n_words, n, name, coverage, a, b in matches(own.tolist(), (hits[rows == row] - first).tolist()):
                        out.append({"doc_id": ids[start + int(row)].as_py(), "license": name, "template": -n, "coverage": coverage, "start": int(a), "end": int(b)})
            yield pa.RecordBatch.from_pylist(out, schema=_HITS)

    return run


_HITS = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, license, template, coverage, start, end) of every match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(tuple(templates), least), "doc_id long, license string, template int, coverage double, start int, end int")
