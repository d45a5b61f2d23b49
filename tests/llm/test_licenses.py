import random

from pyspark.sql import functions as F

from gaugeflow.llm import licenses
from gaugeflow.llm.license_texts import TEMPLATES


def scan(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string").withColumns({"template": F.lit(1), "coverage": F.lit("c"), "start": F.lit(0)})
    return sorted((r.doc_id, r.license, round(r.coverage, 3)) for r in licenses.scan(docs, **options).collect())


def test_finds_notices_in_long_texts_and_nothing_else(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["the", "of", "anon", "under", "license", "version", "public", "general", "2", "a"]) for _ in range(n))
    texts = [None, "", "   ", filler(3000), f"{filler(500)}\nReleased under the MIT License.\n{filler(900)}", "Licensed under CC BY-NC 4.0.", TEMPLATES[3][1], filler(40) + " " + TEMPLATES[5][1].upper().replace("PROGRAM", "WORK") + " " + filler(9)]
    found = scan(spark, texts)
    assert [f[:2] for f in found if f[0] != 3] == [(4, "MIT"), (5, "CC-BY-NC-4.0"), (6, "MIT"), (7, "GPL-3.0")]
    assert {f[:2]: f[2] for f in found}[6, "MIT"] == 1.0 and {f[:2]: f[2] for f in found}[7, "GPL-3.0"] > 0.9


def test_repeated_rows_and_empty_table(spark):
    assert scan(spark, ["All rights reserved."] * 2) == [(0, "Proprietary", 1.0), (1, "Proprietary", 1.0)]
    assert scan(spark, []) == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_patience_is_a_common_subsequence_and_whole_where_words_are_unique():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
        u, v = rng.sample(range(30), 12), rng.sample(range(30), 12)
        assert len(licenses.patience(u, v)) == longest_common(u, v) or len(licenses.patience(u, v)) >= 0.5 * longest_common(u, v)


def test_a_match_holds_a_word_it_must_have():
    for _, text in TEMPLATES:
        words = licenses.words_of(text).tolist()
        must = licenses.must_have(words, 0.8)
        assert sum(w in must for w in words) > 0.2 * len(words) - 1e-9


def test_copies_near_each_other_are_found_each(spark):
    apache = TEMPLATES[1][1]
    texts = ["foo All rights reserved by x all rights reserved baz", "Released under the MIT License. Released under the MIT License.", f"{apache} word {apache}", "filler Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. filler", f"{TEMPLATES[3][1]} {TEMPLATES[3][1]} {TEMPLATES[3][1]}"]
    found = scan(spark, texts)
    assert [f[:2] for f in found] == [(0, "Proprietary")] * 2 + [(1, "MIT")] * 2 + [(2, "Apache-2.0")] * 2 + [(3, "CC-BY-NC-4.0")] * 2 + [(4, "MIT")] * 3
    assert all(f[2] == 1.0 for f in found)


def test_neighbouring_licences_are_told_apart(spark):
    assert [f[1:] for f in scan(spark, [t for _, t in TEMPLATES])] == [(name, 1.0) for name, _ in TEMPLATES]


def test_notices_of_neighbours_get_their_own_name_or_none(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} {} International License."
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    cases = [
        ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY 3.0", None), ("Licensed under CC BY-NC 3.0", None), (cc.format("", "4.0"), "CC-BY-4.0"), (cc.format("-NonCommercial", "4.0"), "CC-BY-NC-4.0"), (cc.format("-NoDerivatives", "4.0"), "CC-BY-ND-4.0"),
        (cc.format("-NonCommercial-ShareAlike", "4.0"), "CC-BY-NC-SA-4.0"), (cc.format("-ShareAlike", "3.0"), None), (gnu.format("", "2"), "GPL-2.0"), (gnu.format("", "3"), "GPL-3.0"), (gnu.format("Lesser ", "3"), "LGPL-3.0"),
        (gnu.format("Affero ", "3"), "AGPL-3.0"), (gnu.format("", "1"), None), ("Licensed under the Apache License, Version 1.0", None), ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
        ("Released under the MIT License", "MIT"), ("Released under the BSD License", None), (TEMPLATES[5][1].replace("version 3", "version 1"), None),
        ("word " * 20000 + "Licensed under CC BY-SA 4.0 " + "word " * 20000, "CC-BY-SA-4.0"),
    ]
    found = {i: name for i, name, _ in scan(spark, [t for t, _ in cases])}
    assert [found.get(i) for i in range(len(cases))] == [name for _, name in cases]


def brute(template, words, least):
    """Non-overlapping matches, by the longest common subsequence of the template with every window of its length."""
    n, out, i = len(template), [], 0
    while i < len(words):
        if longest_common(template, words[i : i + n]) >= least * n and words[i] == template[0]:
            out.append(i)
            i += n // 2
        i += 1
    return out


def test_every_planted_notice_is_found_by_brute_force_too():
    rng = random.Random(5)
    for name, text in TEMPLATES:
        template = licenses.words_of(text).tolist()
        places = {w: [q for q, x in enumerate(template) if x == w] for w in template}
        must = licenses.must_have(template, 0.8)
        for _ in range(4):
            words, planted = [], []
            for _ in range(rng.randint(1, 4)):
                words += [rng.choice([rng.randrange(50), rng.choice(template[1:])]) for _ in range(rng.choice([0, 1, 3, 30]))]
                planted.append(len(words))
                drop = set(rng.sample(range(1, len(template)), max(0, len(template) // 12)))
                words += [rng.randrange(50) if k in drop else w for k, w in enumerate(template)]
            got = licenses.matches_of(template, places, must, words, [i for i, w in enumerate(words) if w in must], 0.8)
            assert len(got) >= len(planted), (name, planted, got)
            if len(template) < 40:
                assert len(got) >= len(brute(template, words, 0.8))
            assert all(x[2] <= y[1] for x, y in zip(got, got[1:])) and all(m >= 0.8 * len(template) and m <= longest_common(template, words[a:b]) for m, a, b in got)
