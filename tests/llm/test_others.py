"""Brute-force versions and edge cases of the sketch, template, mixing, top-k and toxicity operators, and of the pipeline."""

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import curriculum, graph, sketch, templates, toxicity, vafile

DOCS = "doc_id long, text string, lang string, source string, n_chars long, template string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5)))
    rows = [(i * 3 + 1, " ".join(word() for _ in range(rng.randint(0, 120))), rng.choice(["a", "b", "c", None])) for i in range(n)]
    return rows + [(500, None, "a"), (501, "", "b"), (502, " \n ", None), (503, "one", "a"), (503, "one", "a"), (None, "lost id text here now", "b"), (504, "word " * 4000, "c")]


# document fingerprints


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = defaultdict(list)
    for r, n in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", n[1] or ""
        half = len(t) // 2
        out[r[0]].append(hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest())
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("rows", [corpus(1), corpus(2)[:1], [(None, "a b", "x"), (None, "c d", "x")], [(7, "abc d", "x")]])
def test_edited_texts_by_brute_force(spark, rows):
    got = defaultdict(list)
    for r in sketch.fingerprints(docs(spark, rows)).collect():
        got[r.doc_id].append(r.edited_sha256)
    assert {k: sorted(v) for k, v in got.items()} == edited(rows)


def test_fingerprints_estimate_likeness(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    rows = [(3, " ".join(base), "a"), (2, " ".join(base[:3000] + [f"v{i}" for i in range(1000)]), "a"), (1, " ".join(base), "b"), (0, "", "a")]
    got = {r.doc_id: r for r in sketch.fingerprints(docs(spark, rows)).collect()}
    assert got[3].fingerprint == got[1].fingerprint != got[2].fingerprint
    assert abs(got[3].near_next - 0.6) < 0.08 and got[1].near_next == 0.0 and got[0].near_next == 0.0 and got[0].near_edited == 1.0
    assert 0.2 < got[3].near_edited < 0.5
    assert sketch.fingerprints(docs(spark, [])).collect() == []


def test_merged_sketch_is_the_sketch_of_both(spark):
    rng = random.Random(5)
    a, b = (" ".join(str(rng.randrange(50)) for _ in range(400)) for _ in range(2))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.merge(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m"), sketch.sketch(F.col("a")).alias("x"), sketch.sketch(F.col("b")).alias("y")).first()
    limit = (1 << sketch.HASH_BITS) // sketch.FRACTION
    both = set(row.x) | set(row.y)
    assert row.m == sorted(v for v in both if v < limit or v == min(both))


# line dedup


def test_templates_drop_what_recurs_and_keep_the_first(spark):
    prose = lambda i: " ".join(f"p{i}x{'abcdefghij'[j % 10]}{'qrstuv'[(i + j) % 6]}" for j in range(9)).replace("0", "z").translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, f"{prose(i)}\nError code {i} at node n{i}\nsession opened for {'abcdefg'[i]} from the main office\n\nlast {prose(i + 40)}", "s") for i in range(5)]
    rows += [(9, None, "s"), (10, "", "s"), (11, prose(99) + "\n" + prose(99), "s"), (12, "seen twice only", "s"), (13, "seen twice only", "s")]
    got = {r.doc_id: r for r in templates.dedup_lines(docs(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == rows[0][1]
    for i in range(1, 5):
        assert got[i].n_dropped == 2 and got[i].text == f"{prose(i)}\n\nlast {prose(i + 40)}"
    assert got[9].text is None and got[10].text == "" and got[11].n_dropped == 0 and got[12].n_dropped == got[13].n_dropped == 0
    assert templates.dedup_lines(docs(spark, [])).collect() == []


def brute_dedup(rows, depth=3):
    """Line dedup by plain loops over (doc_id, text) with distinct ids."""
    import re

    def masked(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0d]+", line) if t)

    lines = [(i, n, masked(line)) for i, text in rows if text is not None for n, line in enumerate(text.split("\n"))]
    docs = defaultdict(set)
    for i, _, t in lines:
        docs[t].add(i)
    seen = defaultdict(int)
    for t, ids in docs.items():
        for pos, f in enumerate(t):
            seen[len(t), t[:depth], pos, f] += len(ids)
    wide, group = {}, defaultdict(set)
    for t, ids in docs.items():
        marks = [(seen[len(t), t[:depth], pos, f] >= 3, pos >= depth and f != "<*>", f) for pos, f in enumerate(t)]
        constants, plain = sum(a and b for a, b, _ in marks), sum(b for _, b, _ in marks)
        if constants >= 4 and constants >= 0.6 * plain:
            wide[t] = (len(t), t[:depth], tuple(f if a else None for a, _, f in marks))
            group[wide[t]] |= ids
    def keeper(t):
        ids = group[wide[t]] if t in wide and len(group[wide[t]]) >= 3 else docs[t]
        return min(ids) if len(ids) >= 3 else None
    gone = {(i, n) for i, n, t in lines if t and keeper(t) not in (None, i)}
    return {i: None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if (i, n) not in gone) for i, text in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_by_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["red", "blue", "old", "new", "fox", "7up"]) for _ in range(n))
    formats = [lambda: f"the job has finished with code {some(1)} today now", lambda: f"the job has crashed after losing {some(2)} memory pages", lambda: f"This is a {some(1)}", lambda: some(4), lambda: "", lambda: "same " * 40 + some(1) + " tail" * 50]
    rows = [(i, "\n".join(rng.choice(formats)() for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(90, None), (91, "")]
    got = {r.doc_id: r.text for r in templates.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_dedup(rows)


def test_formats_that_begin_alike_are_templates_each(spark):
    rows = [(i, f"the job has finished with code {w} today now") for i, w in enumerate(["ox", "ant", "bee", "cow"])]
    rows += [(10 + i, f"the job has crashed after losing {w} memory pages") for i, w in enumerate(["some", "few", "many", "most", "all", "no"])]
    rows += [(20 + i, f"This is a {w}") for i, w in enumerate(["dog", "house", "test"])]
    long = " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)).replace("0", "o")
    rows += [(30 + i, f"{long} {w} {long}") for i, w in enumerate(["ape", "bat", "cat"])]
    got = {r.doc_id: r.n_dropped for r in templates.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert {i for i, n in got.items() if n} == {1, 2, 3, 11, 12, 13, 14, 15, 31, 32}


@pytest.mark.parametrize("n_tokens", [31, 32, 33, 40, 60, 700])
def test_lines_of_any_length_may_differ_in_several_places(spark, n_tokens):
    def line(i):
        words = [f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n_tokens)]
        for place in (5, n_tokens // 2, n_tokens - 1):
            words[place] = f"own{chr(97 + i)}"
        return " ".join(words)

    rows = [(i, line(i)) for i in range(5)]
    rows += [(10 + i, " ".join(["word", "worda", "wordb", *(f"other{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n_tokens - 3))])) for i in range(4)]
    got = {r.doc_id: r.text for r in templates.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert {i for i, t in got.items() if t == ""} == {1, 2, 3, 4}
    assert got == brute_dedup(rows)


@pytest.mark.parametrize("min_docs", [2, 4])
def test_templates_of_other_least_counts(spark, min_docs):
    rows = [(i, f"the job has finished with code {w} today now", "s") for i, w in enumerate(["ox", "ant", "bee", "cow"])]
    rows += [(10 + i, f"the job has crashed after losing {w} memory pages", "s") for i, w in enumerate(["some", "few"])]
    got = {r.doc_id for r in templates.dedup_lines(docs(spark, rows), min_docs=min_docs).collect() if r.n_dropped}
    assert got == ({1, 2, 3, 11} if min_docs == 2 else {1, 2, 3})


def test_columns_of_the_caller_stay(spark):
    rows = [(i, "a line that all of them have in common", "n", 5, 6) for i in range(3)] + [(None, None, None, None, None), (7, "", "z", 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, template string, n_lines int, n_dropped int")
    out = templates.documents_without_boilerplate(table)
    assert out.columns == table.columns and sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
    assert templates.documents_without_boilerplate(table.limit(0)).collect() == []


def test_repeated_rows_count_once(spark):
    rows = [(1, "the same old line", "s")] * 4
    assert all(r.n_dropped == 0 for r in templates.dedup_lines(docs(spark, rows)).collect())


# mixing


def water(sizes, weights):
    total, left, targets = 1.5 * sum(sizes.values()), set(sizes), {}
    while left:
        w = sum(weights[s] for s in left)
        over = {s for s in left if total * weights[s] / w > 2 * sizes[s]}
        if not over:
            return targets | {s: total * weights[s] / w for s in left}
        for s in over:
            targets[s] = 2.0 * sizes[s]
            total -= targets[s]
        left -= over
    return targets


def test_rows_that_differ_only_in_where_a_null_stands_are_rows_each(spark):
    rows = [(1, "a b c", "en", None, 9, 7), (1, "a b c", None, "en", 9, 7), (2, "d e f g", "en", "en", 9, 7), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, position int, row_key int")
    out = curriculum.mixed_documents(table)
    assert out.columns == table.columns and {r for r in map(tuple, out.collect())} <= set(rows)
    taken = defaultdict(int)
    for r in curriculum.mix(table).collect():
        taken[r.doc_id] += r.taken
    assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())
    assert max(sum(tuple(r) == x for r in out.collect()) for x in rows) <= 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rows = corpus(seed)
    got = curriculum.mix(docs(spark, rows)).collect()
    size = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want = water(sizes, weights)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert r.taken <= 2 * r.size and (r.position is None or 0 <= r.position <= 1)
    assert len(got) == len(rows)
    longest = max(size(t) for _, t, _ in rows)
    for s in sizes:
        ids = [i for i, _, x in rows if x == s]
        part = [r for i in set(ids) for r in by_id[i]]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in part)
        assert abs(sum(r.taken for r in part) - want[s]) <= longest
    assert curriculum.mix(docs(spark, [])).collect() == []
    taken = sum((r.taken // r.size) if r.size else 0 for r in got)
    assert curriculum.mixed_documents(docs(spark, rows)).count() == taken


def test_schedule_inverts_its_integral(spark):
    for knots in curriculum.SCHEDULES:
        shares = [i / 20 for i in range(21)]
        times = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(curriculum.invert_schedule(knots, F.col("s"))).collect()]
        total = sum((w0 + w1) * (t1 - t0) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))

        def integral(t):
            out = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                x = min(max(t - t0, 0), t1 - t0)
                out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            return out / total

        assert all(abs(integral(t) - s) < 1e-9 for t, s in zip(times, shares))


# exact top-k


def test_top_k_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(7)] + [(400, None, 0), (401, [0.1, None] * 4, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (404, [], 0), (None, rows[3][1], 0), (450, [0.5, 0.5], 0), (500, [1.0] * 8, 0)]
    got = [tuple(r) for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 50 == 0, candidate_block=64, query_block=3).collect()]
    import numpy as np

    ok = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    assert sorted(got) == sorted(want)


def brute_top_k(rows, k=5):
    import math

    ok = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want, low, high = [], -(1 << 63), (1 << 63) - 1
    for i in sorted({i for i, _ in ok if i % 50 == 0}):
        asked = {tuple(v) for j, v in ok if j == i}
        found = sorted((-min(max(sum(a * b for a, b in zip(v, w)), low), high), j) for v in asked for j, w in ok if j != i and len(w) == len(v))[:k]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_with_repeats_and_large_components(spark, seed):
    rng = random.Random(seed)
    size = lambda: rng.choice([1e-3, 1.0, 1.0, 1e6, 1e12, 1e17, 1e150])
    rows = [(rng.randrange(120), [rng.gauss(0, 1) * (s := size()) for _ in range(6)]) for _ in range(300)]
    rows += [(i % 130, list(rows[5][1])) for i in range(60)] + [(7, [0.5] * 6), (7, [0.5] * 6), (7, [0.25] * 6), (8, [0.5] * 6), (50, [1.0] * 6), (50, [2.0] * 6), (100, [0.0] * 6)]
    rows += [(200, [1e12] * 6), (250, [-1e12] * 6), (300, [3.0] * 5), (301, [1.0] * 5)]
    got = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, candidate_block=64, query_block=3).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows)


def test_cells_bound_every_inner_product():
    import numpy as np

    rng = np.random.default_rng(3)
    q = np.floor(rng.normal(0, 300, (20, 16)))
    v = np.floor(rng.normal(0, 300, (50, 16)) * 10.0 ** rng.integers(-2, 3, (50, 1)))
    batch = next(vafile._approximate(15)(iter([pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array(v.tolist())], names=["row", "vec_id", "ints"])])))
    cells = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int8).reshape(50, -1)
    lower, upper = vafile.bounds(q, cells, batch.column(3).to_numpy())
    assert (lower <= q @ v.T).all() and (q @ v.T <= upper).all() and (lower < upper).any()


def test_top_k_of_nothing(spark):
    assert vafile.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


# toxicity


def toxic_corpus(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["vermin", "filth"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad), "x"))
    return rows, labels


def test_what_only_a_pair_tells_is_learnt(spark):
    import dataclasses

    import numpy as np
    import pandas as pd

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghijklmnopqrst')}" for _ in range(15)] + ["insult"] * insult + ["group"] * group
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult != group)))
    table, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(table, lab)
    held = table.where(toxicity.fold(F.col("doc_id")) == 0).select("doc_id", toxicity.terms(F.col("text")).alias("terms")).toPandas()
    truth = np.array([labels[i][1] for i in held["doc_id"]])
    agree = lambda m: ((m.scores(pd.Series(held["terms"])) >= 0.5) == truth).mean()
    assert agree(machine) > 0.95
    assert agree(dataclasses.replace(machine, factors=np.zeros_like(machine.factors))) < 0.8  # without pairs


def test_a_pair_that_few_texts_hold_is_learnt(spark):
    import numpy as np
    import pandas as pd

    def made(n, rate, seed):
        rng, rows, labels = random.Random(seed), [], []
        for i in range(n):
            u = rng.random()
            insult, group = u < rate, u < rate / 2 or rate <= u < 1.5 * rate
            words = [f"w{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghijklmnopqrst')}" for _ in range(15)] + ["insult"] * insult + ["group"] * group
            rows.append((i, " ".join(words)))
            labels.append(int(insult and group) if insult or group else int(rng.random() < 1 / 3))
        return rows, labels

    rows, labels = made(10_000, 0.014, 3)
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "doc_id long, toxic int"))
    rows, labels = made(30_000, 0.014, 4)
    held = spark.createDataFrame(rows, "doc_id long, text string").where(F.col("text").rlike("insult|group")).select("doc_id", toxicity.terms(F.col("text")).alias("terms")).toPandas()
    truth = np.array([labels[i] for i in held["doc_id"]])
    assert 0.6 < (truth == 0).mean() < 0.72
    assert ((machine.scores(pd.Series(held["terms"])) >= 0.5) == truth).mean() > 0.8


def test_pairs_by_brute_force(spark):
    import math
    from itertools import combinations

    import numpy as np

    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(40), rng.randint(0, 12))), float(rng.random() < 0.3)) for _ in range(300)]
    share = sum(y for _, y in rows) / len(rows)
    held = {b: [y for t, y in rows if b in t] for b in range(40)}
    known = np.array([b for b in range(40) if b % 7])
    alone = np.array([sum(held[b]) / len(held[b]) for b in known])
    want = dict.fromkeys(known.tolist(), 0.0)
    for a, b in combinations(known.tolist(), 2):
        both = [y for t, y in rows if a in t and b in t]
        m, k = len(both), sum(both)
        if m >= toxicity.LEAST_ROWS:
            p = min(max(sum(held[a]) / len(held[a]) + sum(held[b]) / len(held[b]) - share, share / 4), 1 - share / 4)
            far = 2 * ((k * math.log(k / (m * p)) if k else 0) + ((m - k) * math.log((m - k) / (m * (1 - p))) if k < m else 0))
            for x in (a, b):
                want[x] = max(want[x], math.sqrt(max(far, 0)))
    before, toxicity.PAIR_CELLS = toxicity.PAIR_CELLS, 200
    try:
        got = toxicity.pair_errors(spark.createDataFrame(rows, "terms array<int>, label double"), known, alone, share, 300)
    finally:
        toxicity.PAIR_CELLS = before
    assert sorted(got["bucket"]) == sorted(want)
    assert all(abs(e - want[b]) < 1e-9 for b, e in zip(got["bucket"], got["errors"]))


def test_scores_are_those_of_sparks_machine_in_plain_loops():
    import math

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.1, rng.random(50), rng.normal(size=50), rng.normal(size=(50, 3)), 0.3)
    texts = [[1, 5, 7], [], None, [2], list(range(40))]
    for got, text in zip(m.scores(pd.Series(texts)), texts):
        x = {i: m.weight[i] for i in text or []}
        f = m.intercept + sum(m.linear[i] * v for i, v in x.items()) + sum((m.factors[i] @ m.factors[j]) * x[i] * x[j] for i in x for j in x if i < j)
        assert math.isclose(got, 1 / (1 + math.exp(-f)), rel_tol=1e-9)


def test_toxic_texts_are_told_apart_where_held_out(spark):
    rows, labels = toxic_corpus()
    extra = [(1000, None, "s"), (1001, "", "s"), (None, "vermin", "s"), (3, rows[3][1], "s")]
    lab = spark.createDataFrame(labels + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    kept = toxicity.clean_documents(docs(spark, rows), lab)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and 300 <= kept.count() <= 330


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_labels_that_teach_nothing(spark, labels):
    got = toxicity.toxicity(docs(spark, corpus(1)), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(corpus(1)) and len({r.score for r in got}) == 1
    assert toxicity.toxicity(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# pipeline


def test_each_stage_works_on_what_the_one_before_kept(spark):
    path = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, names = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        names.append(name)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns
            if name != "mixing sources to target weights":
                assert 0 < out.count() <= now.count()
            now = out.cache()
    assert out.count() == now.count() and names == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
