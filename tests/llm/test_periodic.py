"""Runs of words against brute force, their digests and edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.llm import periodic

DOCS = "doc_id long, text string, runs int, collapsed string, n_words string"


def every_run(ids):
    """Stretches of equal words q apart for each q; the smallest q of a stretch is its period."""
    out = {}
    for q in range(1, len(ids) // 4 + 1):
        i = 0
        while i + q < len(ids):
            start = i
            while i + q < len(ids) and ids[i] == ids[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 8), st.integers(0, 40), st.sampled_from([0, 8]))
def test_runs_equal_brute_force(ids, period, tail, direct):
    before, periodic.DIRECT = periodic.DIRECT, direct
    try:
        if len(ids) >= period:
            ids = ids + (ids[-period:] * tail)[:tail]
        assert periodic.runs(ids) == every_run(ids)
    finally:
        periodic.DIRECT = before


@pytest.mark.parametrize("period", [1, 2, 7, 299])
def test_long_periods_are_found_through_hashes(period):
    ids = [i % period for i in range(6000)] + [9999] + list(range(50))
    assert periodic.runs(ids) == [(0, 6000, period)]


def test_binary_words_with_many_runs():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    cubes = [x for x in b[:400] for _ in range(4)]
    assert periodic.runs(cubes) == every_run(cubes) and periodic.runs(b) == every_run(b)


def test_misleading_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 3)
    rng = random.Random(3)
    for _ in range(60):
        ids = [rng.randrange(2) for _ in range(20)] * 1
        ids = ids[:10] + ids[5:9] * 8 + ids
        found = periodic.runs(ids)
        assert all(periodic._is_run(ids, *run) for run in found)


def want(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = every_run(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_digests_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "né", " ", "x y"]) for _ in range(rng.randrange(150)))) for i in range(120)]
    rows += [(7, "ha " * 9), (7, "ha " * 9), (None, "ha ha ha ha ha ha"), (200, None), (201, ""), (202, " \t\r\n\x0b\x0c "), (203, "one　two " * 6), (204, "no run here"), (205, "long text again " * 40000)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    got = periodic.digests(docs).collect()
    short = [r for r in rows if r[0] != 205]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, (r for r in got if r.doc_id != 205))) == sorted(map(key, (want(*r) for r in short)))
    long = next(r for r in got if r.doc_id == 205)
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 120000, 3, 40_000_000)
    assert periodic.digests(docs.limit(0)).collect() == []


def test_find_returns_the_runs_and_the_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so  so so so so so it goes\nit goes it goes it goes on", 1, "x", "y")], DOCS)
    row = periodic.find(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1), (6, 8, 2)] and row.collapsed == "so it goes on" and row.n_words == 15


def test_overlapping_runs_drop_each_word_once():
    words = [b"%d" % i for i in range(20)]
    assert periodic.kept_words(words, [(0, 8, 2), (4, 12, 3)]) == [b"0", b"1", *words[16:]]
