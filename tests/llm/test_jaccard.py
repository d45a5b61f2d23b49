import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gaugeflow.llm import jaccard
from gaugeflow.llm.textgrid import Words

DOCS = "doc_id long, text string, node long, n string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    passage, texts = text(60), []
    for _ in range(12):
        base = text(rng.randint(5, 120))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
        texts.append(text(rng.randint(1, 40)) + passage + text(rng.randint(0, 30)))
    texts += [text(n) for n in (1, 2, 3, 4, 5, 6)] * 2 + [text(3000)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(t), i, "x") for i, t in enumerate(texts)]
    rows += [(900, None, 1, None), (901, "", 1, None), (902, " \n\t ", 1, None), (None, rows[0][1].upper(), 1, None), (rows[1][0], rows[1][1], 1, None), (903, "É é a b c", 1, None), (904, "é é a b c", 1, None)]
    return rows + rows[:2]


def got(spark, rows, **options):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, DOCS), **options).collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_by_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, tree_nodes=2) == brute(rows)  # many trees for a hub


def test_empty_table(spark):
    assert got(spark, []) == []


def test_one_of_each_keeps_the_smallest(spark):
    rows = [(3, "a b c d e f", 0, "x"), (2, "A b c d e f", 0, "x"), (5, "", 0, "x"), (6, None, 0, "x"), (7, "other words entirely", 0, "x"), (None, "no id here", 0, "x"), (None, "nor has this", 0, "x")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "node", "n"] and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "6", "7", "None", "None"]


def test_shared_is_the_same_however_rows_are_batched():
    rng = np.random.default_rng(3)
    token = np.sort(rng.integers(0, 12, 80))
    node = np.concatenate([np.sort(rng.integers(0, 5, (token == t).sum())) for t in range(12)])
    n = node + 100
    want = sorted((int(t), int(x)) for t in set(token) if len(set(node[token == t])) > 1 for x in set(node[token == t]))
    for size in (1, 2, 3, 7, 80):
        batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + size]) for a in (token, node, n)], names=["token", "node", "n"]) for i in range(0, 80, size)]
        rows = [r for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["token"], r["node"]) for r in rows) == want
        assert all(r["n"] == r["node"] + 100 for r in rows)


def test_tree_finds_what_the_bound_admits():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 9, (700, jaccard.GROUPS))
    points[100:130] = points[0] + (rng.random((30, jaccard.GROUPS)) < 0.05)
    sizes = points.sum(axis=1)
    tree = jaccard.CountVectorRTree(points, sizes)
    for i in (0, 5, 110, 699):
        bound = np.minimum(points, points[i]).sum(axis=1)
        assert sorted(tree.search(points[i], sizes[i])) == list(np.flatnonzero(bound >= jaccard.needed(sizes, sizes[i])))


def test_words_of_bytes():
    column = pa.array(["A  b\tc", None, "", "ab", "a b \x0bA b C"])
    w = Words(column)
    assert list(np.diff(w.first)) == [3, 0, 0, 1, 4]
    assert list(w.hashes[:3]) == list(w.hashes[-3:]) and len(set(w.hashes)) == 5


def test_intermediate_tables_go_and_results_stay(spark):
    import glob

    from gaugeflow.llm import common

    folder = common.shared_dir(spark).removeprefix("file:") + "/gaugeflow/"
    before = set(glob.glob(folder + "*"))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 5}x{k}" for k in range(40)) + (" end" if i > 9 else ""), "s") for i in range(20)], "doc_id long, text string, source string")
    out = jaccard.link(docs)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(folder + "*")) - before}
    assert left == {"components", "rows"}
    assert sorted(r.component_id for r in out.collect()) == sorted([i % 5 for i in range(20)])
