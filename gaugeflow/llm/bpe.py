"""Byte-level BPE encoding and decoding through a table of distinct words.

Spark splits every text once into words (the tokenizer's own pattern, special tokens first). Successive
documents form a block of ``BLOCK_WORDS`` words (or one longer document); a block lists its distinct words,
and the place of each word of each text in that list. The words of all blocks meet in one shuffle by word, so that each
distinct word is encoded once; its ids are joined to the table of id and piece, which decodes it; both go
back to the places of the blocks that use the word, where texts get their ids and their decoded text by position.
All joins compare words, ids and places themselves. The way is the same at every size: a shuffle carries a
frequent word once per block, and the table of pieces, the only thing that is broadcast, is as large as the vocabulary.

Blocks are written as a table that is bucketed by block, so that they aren't shuffled again.

Null texts count as empty and have no ids. Rows may repeat or share ids: they are told apart by
their place in the table. Null ids stay null. Further columns are ignored. Empty input gives empty output.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeflow.llm.common import batches_of, frugal_memory, n_partitions, release_memory, scratch_path, text_or_empty

#: Words of a block, unless one document has more: bounds what a task holds.
BLOCK_WORDS = 3_000_000
#: Bytes of split texts that go to a worker at once.
SPLIT_BYTES = 8 << 20
#: White space of the tokenizer's pattern, as ranges of code points (fixed values of the Unicode standard).
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Code points beyond this are no letters or numbers in any published version of the standard.
LAST_LETTER = 0x323AF


def _class(ranges) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def pattern(letter: str = r"\p{L}", number: str = r"\p{N}") -> str:
    """The words of byte-level BPE: contractions, runs of letters, numbers or other signs with a space before, white space."""
    s = _class(WHITE_SPACE)
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]++| ?[{number}]++| ?[^{s}{letter}{number}]++|[{s}]+(?![^{s}])|[{s}]+"


@functools.cache
def newest_pattern(definition: str) -> str:
    """The pattern with the tokenizer's own letters and numbers, for texts with characters newer than the JVM's tables."""
    split, points = Tokenizer.from_str(definition).pre_tokenizer, [c for c in range(0x80, LAST_LETTER + 1) if not 0xD800 <= c <= 0xDFFF]

    def ranges(before: str) -> list[list[int]]:
        joined = {a // 3 for _, (a, b) in split.pre_tokenize_str("".join(f"{before}{chr(c)}\n" for c in points)) if a % 3 == 0 and b - a == 2}
        out: list[list[int]] = []
        for i in sorted(joined):
            if out and out[-1][1] == points[i] - 1:
                out[-1][1] = points[i]
            else:
                out.append([points[i], points[i]])
        return out

    return pattern("A-Za-z" + _class(ranges("x")), "0-9" + _class(ranges("1")))


def read_vocabulary(path: str) -> tuple[str, list[str]]:
    """The tokenizer's definition and its special tokens."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, [t["content"] for t in json.loads(text).get("added_tokens", []) if t.get("special")]


def words(text: Column, special: list[str], newest: str | None = None) -> Column:
    """The words of a text in order; their concatenation is the text. ``newest`` splits texts with characters unknown to the JVM."""

    def plain(t: Column) -> Column:
        known = F.regexp_extract_all(t, F.lit(pattern()), F.lit(0))
        return known if newest is None else F.when(t.rlike(r"\p{Cn}"), F.regexp_extract_all(t, F.lit(newest), F.lit(0))).otherwise(known)

    if not special:
        return plain(text)
    marks = "|".join(rf"\Q{s}\E" for s in special)
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{marks})|(?:(?!{marks}).)+"), F.lit(0))
    split = F.flatten(F.transform(parts, lambda p: F.when(p.isin(special), F.array(p)).otherwise(plain(p))))
    has = F.lit(False)
    for s in special:
        has = has | text.contains(s)
    return F.when(has, split).otherwise(plain(text))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 onwards."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(definition: str) -> list[bytes]:
    """The bytes that each id stands for."""
    tokenizer, stands = Tokenizer.from_str(definition), _byte_of_char()
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i)
        out.append(added[i].encode() if i in added else b"" if token is None else bytes(stands[c] for c in token) if all(c in stands for c in token) else token.encode())
    return out


def _tokenizer(definition: str) -> Tokenizer:
    """A task has one core, so the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


PACKED_AT_ONCE = 1 << 18


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2**28 as one to four bytes each, seven bits a byte, the last byte of each below 128."""
    return b"".join(_packed(values[i : i + PACKED_AT_ONCE]) for i in range(0, len(values), PACKED_AT_ONCE))


def _packed(values: np.ndarray) -> bytes:
    more = [values >= 1 << 7 * k for k in (1, 2, 3)]
    length = 1 + sum(m.astype(np.int64) for m in more)
    start = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    for k in range(4):
        rows = slice(None) if k == 0 else more[k - 1]
        v, n = values[rows], length[rows]
        out[start[rows] + k] = (v >> 7 * k & 127) | np.where(n > k + 1, 128, 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *unpacked_parts(data)])


def unpacked_parts(data: bytes) -> Iterator[np.ndarray]:
    """What ``unpacked`` gives, a few numbers at a time."""
    raw, at = np.frombuffer(data, np.uint8), 0
    while at < len(raw):
        ends = np.flatnonzero(raw[at : at + PACKED_AT_ONCE] < 128)
        starts = np.concatenate([[0], ends[:-1] + 1])
        out = np.zeros(len(ends), np.int32)
        for k in range(4):
            rows = np.flatnonzero(starts + k <= ends) if k else slice(None)
            out[rows] |= (raw[at + starts[rows] + k].astype(np.int32) & 127) << 7 * k
        yield out
        at += int(ends[-1]) + 1


BLOCKS = "block long, doc_ids array<bigint>, sizes array<int>, places binary, words array<string>"


def _blocks(block_words: int):
    """Rows (row, doc_id, words) to blocks: the distinct words of successive documents, commonest first (then in order, which compresses well), and the place of each word of each text among them."""

    def block(row: int, parts: list[tuple]) -> pa.RecordBatch:
        found = pa.chunked_array([p[2] for p in parts]).unify_dictionaries()
        index, names = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in found.chunks]), found.chunk(0).dictionary
        count = np.zeros(len(names), np.int64)
        for i in range(0, len(index), PACKED_AT_ONCE):
            count += np.bincount(index[i : i + PACKED_AT_ONCE], minlength=len(names))
        order = pc.sort_indices(pa.table({"n": count, "word": names}), [("n", "descending"), ("word", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        doc_ids, sizes = pa.chunked_array([p[0] for p in parts]).combine_chunks(), np.concatenate([p[1] for p in parts]).astype(np.int32)
        listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (doc_ids, pa.array(sizes), names.take(pa.array(order)))]
        return pa.RecordBatch.from_arrays([pa.array([row]), listed[0], listed[1], pa.array([packed(place[index])], pa.binary()), listed[2]], names=["block", "doc_ids", "sizes", "places", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal_memory()
        row, parts, n = None, [], 0
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - 1 + n) // block_words
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if batch.num_rows else []
            for i, j in zip(cut, [*cut[1:], batch.num_rows]):
                if parts and part[i] > 0:
                    yield block(row, parts)
                    parts, n = [], 0
                    release_memory()
                row = batch.column(0)[i].as_py() if not parts else row
                parts.append((batch.column(1).slice(i, j - i), sizes[i:j], batch.column(2).slice(i, j - i).flatten().dictionary_encode()))
                n += int(sizes[i:j].sum())
        if parts:
            yield block(row, parts)
        release_memory()

    return run


def blocks_of(docs: DataFrame, definition: str, special: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of ``docs``, written once to the shared folder as a table bucketed by block. A block is named by the number of its first row."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(text_or_empty(), special, newest_pattern(definition)).alias("words"))
    name = f"gaugeflow_blocks_{uuid.uuid4().hex}"
    out = rows.mapInArrow(_blocks(block_words), BLOCKS).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option("path", scratch_path(spark, "bpe-blocks"))
    with batches_of(spark, SPLIT_BYTES):
        out.bucketBy(n_partitions(spark), "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are in the shared folder, and ``blocks`` knows them and their buckets
    return blocks


def _encode(definition: str):
    """Rows (word, block, place) in order of word to a row per distinct word of a batch: its ids and the places that use it. A word that goes on in the next batch keeps its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal_memory()
        tokenizer, last, held = _tokenizer(definition), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            run = pc.run_end_encode(batch.column(0))
            distinct, ends = run.values.to_pylist(), run.run_ends.to_numpy(zero_copy_only=False)
            known = distinct[0] == last
            ids = [held] if known else []
            ids += [e.ids for e in tokenizer.encode_batch_fast(distinct[int(known) :], add_special_tokens=False)]
            last, held = distinct[-1], ids[-1]
            uses = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["block", "place"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), uses], names=["ids", "uses"])
        del tokenizer
        release_memory()

    return encode


#: Uses of words that a task gathers before it sends them to their blocks.
USES_AT_ONCE = 400_000
SENT = "block long, places binary, counts binary, ids binary, lengths binary, decoded binary"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, id, piece, uses, word), the ids of a word one after the other, to a row for each block of what its words are encoded and decoded to."""
    frugal_memory()
    held, gathered, n = None, [], 0
    for batch in batches:
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        at, word = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 4))
        if (at[:1] != 0).any() or ((at[1:] != 0) & ((at[1:] != at[:-1] + 1) | (word[1:] != word[:-1]))).any():
            raise ValueError("the ids of a word must follow each other")
        first = np.flatnonzero(at == 0)
        if not len(first):
            continue
        held = rows.slice(int(first[-1]))
        gathered.append(_uses(rows.slice(0, int(first[-1])), first))
        n += len(gathered[-1])
        if n >= USES_AT_ONCE:
            yield _by_block(gathered)
            gathered, n = [], 0
    if held is not None:
        yield _by_block([*gathered, _uses(held, np.array([0, held.num_rows]))])
    del gathered, held
    release_memory()


def _uses(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.Table:
    """(block, place, ids, decoded) of every use of the words that ``bounds`` part."""
    ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows.column(1))
    decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows.column(2)), b"")
    uses = rows.column(3).take(pa.array(bounds[:-1]))
    word, use = pc.list_parent_indices(uses), uses.flatten()
    return pa.table({"block": use.field(0), "place": use.field(1), "ids": ids.take(word), "decoded": decoded.take(word)})


def _by_block(gathered: list[pa.Table]) -> pa.RecordBatch:
    uses = pa.concat_tables(gathered).sort_by([("block", "ascending"), ("place", "ascending")]).combine_chunks()
    block, out = uses["block"].to_numpy(), []
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(block) else []
    for i, j in zip(cut, [*cut[1:], len(block)]):
        part = uses.slice(i, j - i)
        ids, decoded = part["ids"].combine_chunks(), part["decoded"].combine_chunks()
        numbers = [np.diff(part["place"].to_numpy(), prepend=0), ids.value_lengths().to_numpy(), ids.flatten().to_numpy(), pc.binary_length(decoded).to_numpy()]
        cells = [*map(packed, numbers), b"".join(decoded.to_pylist())]
        out.append((int(block[i]), *(zstandard.compress(c, 9) for c in cells)))
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["block", "places", "counts", "ids", "lengths", "decoded"])


def piece_table(spark: SparkSession, definition: str) -> DataFrame:
    """(id, piece): the bytes that each id stands for."""
    found = pieces(definition)
    rows = pa.table({"id": pa.array(range(len(found)), pa.int32()), "piece": pa.array(found, pa.binary())})  # a list of rows would take Python workers of another kind, which stay beside those of the tasks
    return spark.createDataFrame(rows, "id int, piece binary")


def word_codes(blocks: DataFrame, definition: str) -> DataFrame:
    """Rows of ``SENT``: for words of a block, their places, ids and the bytes they decode to. Each distinct word is encoded and decoded once.

    The join to the pieces is a broadcast join, so the ids of a word stay one after the other; where they are put together, word and place are checked.
    """
    used = blocks.select("block", F.posexplode("words").alias("place", "word")).select("word", "block", "place")
    encoded = used.repartition("word").sortWithinPartitions("word").mapInArrow(_encode(definition), "ids array<int>, uses array<struct<block:bigint,place:int>>")
    numbered = encoded.select("uses", "ids", F.monotonically_increasing_id().alias("word"))
    each = numbered.select("word", "uses", F.posexplode("ids").alias("at", "id")).select("word", "id", "at", F.when(F.col("at") == 0, F.col("uses")).alias("uses"))
    joined = each.join(F.broadcast(piece_table(blocks.sparkSession, definition)), "id").select("at", "id", "piece", "uses", "word")
    return joined.mapInArrow(_decoded, SENT)


def _slices(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def _assembled(block: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a block: ids and decoded text by position."""
    frugal_memory()
    place, ids_of, text_of = [np.zeros(0, np.int64)], [], []
    for places, counts, ids, lengths, decoded in zip(*(found[c].to_pylist() for c in ("places", "counts", "ids", "lengths", "decoded"))):
        places, counts, ids, lengths, decoded = map(zstandard.decompress, (places, counts, ids, lengths, decoded))
        place.append(np.cumsum(unpacked(places)))
        ids_of += _slices(unpacked(ids).tobytes(), 4 * unpacked(counts))
        text_of += _slices(decoded, unpacked(lengths))
    place = np.concatenate(place)
    n_words = len(place)
    if block.num_rows != 1 or len(np.unique(place)) != n_words or (n_words and place.max() != n_words - 1):
        raise ValueError("a block and its words must meet once")
    by_place = np.empty((2, n_words), object)
    by_place[0, place], by_place[1, place] = ids_of, text_of
    del ids_of, text_of
    del place, found
    release_memory()
    done = [_texts_of(by_place, sizes, places) for sizes, places in _pieces_of(block["sizes"][0].as_py(), block["places"][0].as_py())]
    del by_place
    release_memory()
    doc_id = block["doc_ids"].combine_chunks().flatten()
    return pa.concat_tables(done).add_column(0, "doc_id", doc_id)


def _pieces_of(sizes: list[int], packed_places: bytes) -> Iterator[tuple[list[int], np.ndarray]]:
    """(sizes, places) of successive documents of a block, about ``PACKED_AT_ONCE`` words or one document at a time."""
    parts, held, first, n = unpacked_parts(packed_places), [], 0, 0
    for row, size in enumerate(sizes):
        n += size
        if n >= PACKED_AT_ONCE or row + 1 == len(sizes):
            while sum(map(len, held)) < n:
                held.append(next(parts))
            places = np.concatenate([np.zeros(0, np.int32), *held])
            yield sizes[first : row + 1], places[:n]
            held, first, n = [places[n:].copy()], row + 1, 0


def _texts_of(by_place: np.ndarray, sizes: list[int], places: np.ndarray) -> pa.Table:
    """The ids and decoded texts of documents of ``sizes`` words, one after the other."""
    ids, texts, at = [], [], 0
    for size in sizes:
        own = places[at : at + size]
        ids.append(np.frombuffer(b"".join(by_place[0, own]), np.int32))
        texts.append(b"".join(by_place[1, own]).decode("utf-8", "replace"))
        at += size
    return pa.table({"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())})


def encode_and_decode(docs: DataFrame, vocabulary: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs``: token ids and the text that they decode to."""
    definition, special = read_vocabulary(vocabulary)
    blocks = blocks_of(docs, definition, special, block_words)
    codes = word_codes(blocks, definition)
    release_memory()  # the tokenizers that the driver has read
    rows = blocks.select("block", "doc_ids", "sizes", "places")
    return rows.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_assembled, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    out = encode_and_decode(docs, vocabulary, **options)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
