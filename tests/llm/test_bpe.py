import hashlib
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  a", "it's we'll I'D  don't", "Über café — 12½ ٣٤ 日本語　x", "a<|endoftext|> b <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "tab\t\tx \r\n y\x85z\xa0 w", "ࡰࢵ \U00010570a \U0001ccf011",
    "👩‍👩‍👧 é ﻿", "long " * 3000, "same", "same", "trailing   ",
]


def expected():
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i % 14, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block_words", [bpe.BLOCK_WORDS, 7])
def test_same_as_the_library(spark, block_words):
    docs = spark.createDataFrame([(i % 14, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    assert sorted(tuple(r) for r in bpe.digests(docs, PATH, block_words=block_words).collect()) == expected()


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in range(1, 29)] + [np.array([0, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])])
    assert (bpe.unpacked(bpe.packed(values)) == values).all()
    assert len(bpe.unpacked(bpe.packed(np.zeros(0, np.int64)))) == 0


def test_ids_and_text_themselves(spark):
    docs = spark.createDataFrame([(1, "a word, a word"), (2, None)], "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    assert sorted(map(tuple, bpe.encode_and_decode(docs, PATH).collect())) == [(1, t.encode("a word, a word").ids, "a word, a word"), (2, [], "")]


def test_empty_table(spark):
    assert bpe.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_words_join_to_the_text(spark):
    from pyspark.sql import functions as F

    definition, special = bpe.read_vocabulary(PATH)
    docs = spark.createDataFrame([(t or "",) for t in TEXTS], "text string")
    rows = docs.select("text", F.array_join(bpe.words(F.col("text"), special, bpe.newest_pattern(definition)), "").alias("joined")).collect()
    assert all(r.text == r.joined for r in rows)


def test_no_table_is_left_and_blocks_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a word, a word"), (2, None)], "doc_id long, text string")
    out = bpe.encode_and_decode(docs, PATH)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("gaugeflow")]
    assert out.count() == 2 and "Bucketed: true" in out._jdf.queryExecution().toString()


def test_numbers_and_documents_in_parts():
    rng = np.random.default_rng(3)
    sizes = [0, 5, 0, *rng.integers(0, 200_000, 12).tolist(), 3 * bpe.PACKED_AT_ONCE, 0, 7, 0]
    places = rng.integers(0, 1 << 21, sum(sizes)).astype(np.int32)
    parts = list(bpe._pieces_of(sizes, bpe.packed(places)))
    assert [s for part, _ in parts for s in part] == sizes and all(sum(s) == len(p) for s, p in parts)
    assert (np.concatenate([p for _, p in parts]) == places).all() and len(parts) > 3
    assert list(bpe._pieces_of([], b"")) == [] and [s for s, _ in bpe._pieces_of([0, 0], b"")] == [[0, 0]]


def test_pieces_need_no_python_workers(spark):
    # workers of a list of rows stay, idle, beside those that encode
    found = bpe.piece_table(spark, bpe.read_vocabulary(PATH)[0])
    assert "PythonRDD" not in found._jdf.queryExecution().toRdd().toDebugString()
    assert found.count() == len(bpe.pieces(bpe.read_vocabulary(PATH)[0]))


def test_a_worker_gives_back_what_it_has_freed():
    code = """
import re
import numpy as np, pyarrow as pa
from gaugeflow.llm.common import frugal_memory
own = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
before, kept = own(), []
frugal_memory()
for _ in range(2):
    held = [(np.ones(3 << 20, np.uint8), pa.array(np.ones(1 << 19)).cast(pa.int32()), bytes(3000)) for _ in range(40)]
    kept += [h[2] for h in held]
    del held
print(own() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, stdout=subprocess.PIPE, check=True).stdout) < 80  # else about 220
