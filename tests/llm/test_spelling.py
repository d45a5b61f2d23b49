"""Near words against brute force, refinement of crowded segments, forms and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from gaugeflow.llm import spelling

DOCS = "doc_id long, text string, word string, form string, n int"


def near(a, b):
    """Exactly one letter replaced, inserted or deleted."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def pairs_of(words):
    return {tuple(sorted((a, b), key=lambda w: (len(w), w))) for i, a in enumerate(words) for b in words[:i] if near(a, b)}


@pytest.mark.parametrize("most_pairs", [0, 3, 4096])
def test_pairs_equal_brute_force(spark, most_pairs):
    rng = random.Random(most_pairs)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(250)}
    words |= {"common" + "".join(rng.choice("xyzß") for _ in range(rng.randint(0, 7))) for _ in range(250)} | {"a", "b", "ab"}
    words = sorted(words)
    got = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), most_pairs).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(p, key=lambda w: (len(w), w))) for p in got} == pairs_of(words)


def test_a_segment_that_most_words_share_is_cut_on(spark):
    """3,000 words with one prefix: no segment brings together a tenth of the pairs that the prefix alone would."""
    rng = random.Random(5)
    words = sorted({"prefixes" + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3000)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.a, r.b) for r in spelling.near_pairs(frame, 64).collect()}
    buckets = {}
    for w in words:
        for i in range(len(w)):
            buckets.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert got == {(a, b) for group in buckets.values() for a in group for b in group if a < b}


def want(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
        out[w] = (n, len(others))
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, k, counts.get(form[w])) for w, (n, k) in out.items())


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    letters = "abÀÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base[: rng.randint(1, 60)]) + rng.choice(["", ",", "1", "S"]) for _ in range(rng.randrange(200)))) for i in range(150)]
    chain = ["roottt"] * 700 + ["roottx"] * 130 + ["rootyx"] * 25 + ["rozzyx"] * 5 + ["Rootyx"]
    rows += [(900, " ".join(chain)), (None, "without an id " * 7), (901, None), (902, ""), (903, "12 -- \n"), (904, "twices " * 9), (904, "twices " * 9), (905, "É" * 9 + "x" * 50000), (906, "ß×÷abc " * 6)]
    docs = spark.createDataFrame([(i, t, "w", "f", 0) for i, t in rows], DOCS)
    got = spelling.variants(docs, edit=True)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want(rows), key=str)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    words = [("aaaaaa", 10**9), ("aaaaab", 10**8), ("aaaabb", 10**7), ("aaabbb", 10**6), ("aabbbb", 10**5), ("abbbbb", 10**4), ("lonely", 7)]
    got = {r.word: (r.form, r.root) for r in spelling.forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abbbbb"] == ("aabbbb", "aaaaaa") and got["aaaaaa"] == (None, "aaaaaa") and got["lonely"] == (None, "lonely")


def test_ties_go_to_the_smallest_in_code_point_order(spark):
    words = [("wordsﬁ", 50), ("wordsz", 50), ("words\U00010000", 50), ("wordsa", 5)]
    got = {r.word: (r.form, r.n_near) for r in spelling.forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["wordsa"] == ("wordsz", 3) and got["wordsz"] == (None, 3)
