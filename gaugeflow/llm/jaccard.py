"""Exact n-gram Jaccard join with count vectors in R-trees.

A document is the set of its five-word shingles; equal sets are one node. Shingles are hashed into
``GROUPS`` groups, and a node's group counts are a point; the sum of the coordinate minima of two
points bounds the overlap of their sets from above, and so does that of a point and the maxima of
an R-tree box for every point within.

Which points share trees: two sets that link share a shingle among the first ``n - ceil(0.75 n) + 1`` of each in
any order that both follow, so a tree over all documents isn't needed (the boxes of count vectors prune too little there). The order puts shingles that occur often (counted over all documents,
block by block) last, so that common passages don't bring unrelated documents together. Copies of a
set within a task are emitted once. Each shared shingle names one of its nodes as hub (the one with
most shared shingles); the nodes around a hub are dealt to R-trees of about ``TREE_NODES`` points.

Every pair comes out of a search of these trees and is verified on the exact sets. First the hub searches the trees of its nodes,
which joins groups of near copies with as many pairs as members. Where the nodes around a hub are still in different components, those
outside the largest one then search its trees for nodes of other components. Links within a component that is already joined change nothing and aren't looked for.

Null and empty texts have an empty set and are alone. Repeated rows and ids are handled as rows of
their own; a component's id is its smallest doc_id, null only where all its ids are null. Extra
columns are ignored by ``link`` and kept by ``one_of_each``. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import passing_tables, row_key, stash
from gaugeflow.llm.graph import components
from gaugeflow.llm.textgrid import Words, mix, slices

SHINGLE = 5
#: Similarity as a fraction: sets link when ``DEN * overlap >= NUM * union``.
NUM, DEN = 3, 4
GROUPS = 512
#: Shingles counted together, the count in such a block from which one is common, and how many common ones are ordered last.
COUNTED = 4_000_000
COMMON = 2
COMMON_KEPT = 3_000_000
FAN_OUT = 16
#: Nodes of a tree, about, and sets that a task remembers so that it doesn't emit them twice.
TREE_NODES = 1024
REMEMBERED = 1_000_000
#: Bits of the filter that tells which sets are needed for verification; its size doesn't depend on the data.
FILTER_BITS = 1 << 26


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap with which sets of sizes ``a`` and ``b`` link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def count_vectors(values: np.ndarray, first: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group counts of each set."""
    rows = len(first) - 1
    group = (mix(values) % np.uint64(groups)).astype(np.int64) + np.repeat(np.arange(rows), np.diff(first)) * groups
    return np.bincount(group, minlength=rows * groups).reshape(rows, groups)


_WIDTHS = (np.uint8, np.uint16, np.uint32)


def as_bytes(vectors: np.ndarray) -> list[bytes]:
    """Group counts as the narrowest numbers that hold them."""
    most = vectors.max(axis=1, initial=0)
    return [v.astype(_WIDTHS[int(m > 0xFF) + int(m > 0xFFFF)]).tobytes() for v, m in zip(vectors, most.tolist())]


def from_bytes(cells: list[bytes]) -> np.ndarray:
    kinds = {len(c) // GROUPS for c in cells}
    if len(kinds) == 1:
        return np.frombuffer(b"".join(cells), f"u{kinds.pop()}").reshape(-1, GROUPS).astype(np.int32)
    return np.stack([np.frombuffer(c, f"u{len(c) // GROUPS}") for c in cells]).astype(np.int32)


def nodes_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set of hashes; what an empty set has means nothing."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total = np.add.reduceat(mix(values + np.uint64(0x51ED27)), first[full])
        out[full] = mix(total ^ mix(np.bitwise_xor.reduceat(values, first[full]) + np.diff(first)[full].astype(np.uint64)))
    return out.view(np.int64)


def _sets(batch: pa.RecordBatch):
    """(first row, values, starts, nodes) of a batch's sets, a few MB of text at a time."""
    for start, part in slices(batch.column(batch.schema.get_field_index("text"))):
        values, first = Words(part).shingle_sets(SHINGLE)
        yield start, values, first, nodes_of(values, first)


def unseen(nodes: np.ndarray, first: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have a set that this task hasn't met; they count as met from now on."""
    out = np.zeros(len(nodes), bool)
    if len(seen) > REMEMBERED:
        seen.clear()
    for i, (node, size) in enumerate(zip(nodes.tolist(), np.diff(first).tolist())):
        if size and node not in seen:
            seen.add(node)
            out[i] = True
    return out


_NODES = pa.schema([("kind", pa.int32()), ("row_key", pa.string()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])
NODES = "kind int, row_key string, doc_id long, node long, n long, vector binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (kind 0) for each document, and one (kind 1: node is a shingle, n its count) for each common shingle of a block."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def common() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= COMMON
        n = int(often.sum())
        nothing = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.string()), nothing, pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.nulls(n, pa.binary())], schema=_NODES)

    for batch in batches:
        nodes, sizes, vectors = [], [], []
        for _, values, first, keys in _sets(batch):
            n = np.diff(first)
            nodes.append(pa.array(keys, mask=n == 0))
            sizes.append(n)
            vectors += as_bytes(count_vectors(values, first))
            held.append(values[np.repeat(unseen(keys, first, seen), n)])
            size += len(held[-1])
            if size >= COUNTED:
                yield common()
                held.clear()
                seen.clear()
                size = 0
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), get("row_key"), get("doc_id"), pa.concat_arrays(nodes), pa.array(np.concatenate(sizes)), pa.array(vectors, pa.binary())], schema=_NODES)
    if held:
        yield common()


def prefixes_of(values: np.ndarray, first: np.ndarray, rows: np.ndarray, common: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the chosen rows' sets in the common order (uncommon shingles first, then by how common they are,
    then by hash), one after the other, and their lengths."""
    rank = np.zeros(len(values), np.int8)
    if len(common) and len(values):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        rank = np.where(common[at] == values, level[at], np.int8(0))
    parts, lengths = [], []
    for i in rows.tolist():
        a, b = first[i], first[i + 1]
        size = prefix_size(int(b - a))
        own = values[a:b]
        parts.append(own[np.argsort(rank[a:b], kind="stable")[:size]] if rank[a:b].any() else own[:size])
        lengths.append(size)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array(lengths, np.int64)


def _prefixes(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, level = common.value
        seen: set[int] = set()
        for batch in batches:
            for _, values, first, keys in _sets(batch):
                rows = np.flatnonzero(unseen(keys, first, seen))
                tokens, lengths = prefixes_of(values, first, rows, shingles, level)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.repeat(keys[rows], lengths)), pa.array(np.repeat(np.diff(first)[rows], lengths))], names=["token", "node", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (token, node): those of tokens with several nodes."""
    last = None  # token, node, n of the row before; whether its token's first row was emitted; the node of that row
    for batch in batches:
        token, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if last is not None:
            token, node, n = np.concatenate([[last[0]], token]), np.concatenate([[last[1]], node]), np.concatenate([[last[2]], n])
        if not len(token):
            continue
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        start = np.ones(len(token), bool)
        start[1:] = token[1:] != token[:-1]
        head = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
        leader = node[head]
        carried = last is not None
        if carried:
            mine = head == 0
            leader = np.where(mine, last[4], leader)
        follower = fresh & (node != leader)
        if carried:
            follower[0] = False
        several = np.zeros(len(token), bool)
        several[head[follower]] = True
        keep = follower | (start & several)
        if carried and last[3]:
            keep[0] = False  # emitted before
        elif carried:
            keep[0] = several[0]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, n)], names=["token", "node", "n"])
        end = head[-1]
        done = bool(several[end] or (end == 0 and carried and last[3]))
        last = (token[-1], node[-1], n[-1], done, leader[-1])


SHARED = "token long, node long, n long"


class CountVectorRTree:
    """R-tree over points of group counts, packed by size and then by the largest coordinates' order; boxes keep maxima and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan_out: int = FAN_OUT):
        shape = np.lexsort((points.argmax(axis=1), np.round(np.log(np.maximum(sizes, 1)) * 8)))
        self.order, self.fan_out = shape, fan_out
        self.levels = [(points[shape], sizes[shape], sizes[shape])]
        while len(self.levels[-1][0]) > fan_out:
            box, low, high = self.levels[-1]
            cut = np.arange(0, len(box), fan_out)
            self.levels.append((np.maximum.reduceat(box, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places of the points whose bound lets them link with ``point``."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            box, low, high = self.levels[depth]
            fits = (high[at] * DEN >= NUM * size) & (low[at] * NUM <= DEN * size)
            at = at[fits]
            bound = np.minimum(box[at], point).sum(axis=1)
            at = at[bound >= needed(np.maximum(low[at], -(-NUM * size // DEN)), size)]
            if depth:
                at = (at[:, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (hub, block, asks, node, n, component, apart, vector) in order of (hub, block, asks): pairs of nodes of different
    components that pass the bound.

    A block's tree holds its rows that don't ask; each row that asks searches it. ``apart`` tells nodes that ask somewhere: two
    of them meet twice, and count where the smaller node asks.
    """
    key, parts, tree = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        hub, block, asks, node, size, comp, apart = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        cut = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])]))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for i, j in zip(cut, [*cut[1:], batch.num_rows]):
            if key != (hub[i], block[i]):
                key, parts, tree = (hub[i], block[i]), [], None
            vectors = from_bytes(batch.column(7).slice(i, j - i).to_pylist())
            if not asks[i]:
                parts.append((vectors, size[i:j], node[i:j], comp[i:j], apart[i:j]))
                continue
            if not parts:
                continue
            if tree is None:
                points, sizes, nodes, comps, aparts = (np.concatenate([p[c] for p in parts]) for c in range(5))
                tree = CountVectorRTree(points, sizes)
            for q in range(j - i):
                at = tree.search(vectors[q], int(size[i + q]))
                at = at[(comps[at] != comp[i + q]) & (~aparts[at] | (nodes[at] > node[i + q]))]
                out[0].append(np.minimum(nodes[at], node[i + q]))
                out[1].append(np.maximum(nodes[at], node[i + q]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "b"])


def _needed_sets(wanted):
    """(node, tokens) of the documents whose node may be wanted; a node once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            for _, values, first, keys in _sets(batch):
                bit = keys % FILTER_BITS
                if len(words):
                    at = np.minimum(np.searchsorted(words, bit >> 6), len(words) - 1)
                    maybe = (words[at] == bit >> 6) & ((bits[at] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0) & (np.diff(first) > 0)
                else:
                    maybe = np.zeros(len(keys), bool)
                rows = [i for i in np.flatnonzero(maybe).tolist() if keys[i] not in seen]
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(keys[rows].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array([values[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "tokens"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        left, right = batch.column(2), batch.column(3)
        good = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            good.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(good, pa.bool_())), b.filter(pa.array(good, pa.bool_()))], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. Sets are made again from the texts, of the nodes that a fixed-size filter lets through."""
    spark: SparkSession = pairs.sparkSession
    bit = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    marks = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).select(bit.alias("bit"))
    marks = marks.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).orderBy("word").toPandas()
    wanted = spark.sparkContext.broadcast((marks["word"].to_numpy(np.int64), marks["bits"].to_numpy(np.int64).view(np.uint64)))
    sets = stash(texts.select("text").mapInArrow(_needed_sets(wanted), "node long, tokens binary"), "sets").groupBy("node").agg(F.first("tokens").alias("tokens"))
    left = sets.withColumnsRenamed({"node": "a", "tokens": "left"})
    right = sets.withColumnsRenamed({"node": "b", "tokens": "right"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify, "a long, b long")


def searched(members: DataFrame, points: DataFrame, top: DataFrame, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): pairs of nodes of a hub that the bound lets link, found in R-trees.

    ``members`` has (hub, node, n, component), ``top`` for each hub that is searched the component whose nodes don't ask. The nodes of a
    hub are dealt to trees of about ``tree_nodes``; those of other components than the top one search all of them.
    """
    blocks = members.groupBy("hub").agg(F.ceil(F.count("*") / tree_nodes).cast("int").alias("blocks"))
    rows = members.join(top, "hub").join(blocks, "hub").withColumn("apart", F.col("component") != F.col("top"))
    rows = rows.join(points, "node")
    own = F.struct(F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block"), F.lit(False).alias("asks"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.cast("int").alias("block"), F.lit(True).alias("asks")))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("apart"), F.concat(F.array(own), every)).otherwise(F.array(own))))
    dealt = dealt.select("hub", "at.block", "at.asks", "node", "n", "component", "apart", "vector")
    return dealt.repartition("hub", "block").sortWithinPartitions("hub", "block", "asks").mapInArrow(_tree_pairs, "a long, b long").distinct()


def node_links(texts: DataFrame, nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): verified links that join the nodes of each component of the full link graph."""
    spark = texts.sparkSession
    shared_common = spark.sparkContext.broadcast(common)
    prefixes = texts.select("text").mapInArrow(_prefixes(shared_common), "token long, node long, n long")
    shared = stash(prefixes.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared, SHARED), "shared")
    # the hub of a shingle is the node that shares most shingles: of a group of edited copies, their original
    degree = shared.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = shared.join(degree, "node").groupBy("token").agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
    star = stash(shared.join(hubs, "token").select(F.col("hub.node").alias("hub"), "node", "n").distinct(), "star")
    points = nodes.select("node", "vector").groupBy("node").agg(F.first("vector").alias("vector"))
    # first each hub searches the tree of its nodes: it is one component, the others together are the other
    alone = star.withColumn("component", (F.col("node") == F.col("hub")).cast("long"))
    near = stash(searched(alone, points, star.select("hub", F.lit(0).cast("long").alias("top")).distinct(), tree_nodes), "near")
    links = stash(verified(near, texts), "star-links")
    joined = stash(components(links), "joined")
    # then, around hubs whose nodes are still apart, what is not in the largest component
    members = star.join(joined, "node", "left").select("hub", "node", "n", F.coalesce("component", "node").alias("component"))
    members = stash(members, "members")
    sizes = members.groupBy("hub", "component").agg(F.count("*").alias("size"))
    top = sizes.groupBy("hub").agg(F.max(F.struct("size", "component")).alias("largest"), F.count("*").alias("parts")).where(F.col("parts") > 1).select("hub", F.col("largest.component").alias("top"))
    rest = stash(searched(members, points, top, tree_nodes).join(near, ["a", "b"], "left_anti"), "tree-pairs")
    return links.unionByName(verified(rest, texts))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for i, kind in ((0, np.int64), (1, np.int8))], names=["shingles", "levels"])


def common_shingles(survey: DataFrame, most: int = COMMON_KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, sorted, with a level that grows with their counts: the levels from the top that hold ``most`` together."""
    counts = stash(survey.where(F.col("kind") == 1).groupBy("node").agg(F.sum("n").alias("n")).select("node", F.floor(F.log2("n") * 4).cast("int").alias("level")), "common")
    sizes, least, total = counts.groupBy("level").count().collect(), 127, 0
    for level, n in sorted(sizes, reverse=True):
        total += n
        if total > most:
            break
        least = level
    kept = counts.where(F.col("level") >= least).mapInArrow(_packed, "shingles binary, levels binary").collect()
    shingles = np.frombuffer(b"".join(r[0] for r in kept), np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.frombuffer(b"".join(r[1] for r in kept), np.int8)[order] + np.int8(1)


def key_string(docs: DataFrame) -> Column:
    """A row's key as one string."""
    key = row_key(docs)
    return F.concat_ws("-", F.hex(key["a"]), F.hex(key["b"]))


def link(docs: DataFrame, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, component) of every row of ``docs``; component is null without words."""
    spark = docs.sparkSession
    texts = docs.select(key_string(docs).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    with passing_tables(spark, keep=2):
        survey = stash(texts.mapInArrow(_survey, NODES), "survey")
        common = common_shingles(survey)
        every = survey.where(F.col("kind") == 0)
        found = stash(components(node_links(texts, every.where(F.col("node").isNotNull()), common, tree_nodes)), "components")
        rows = stash(every.select("row_key", "doc_id", "node", "n"), "rows")
    nodes = rows.where(F.col("node").isNotNull())
    named = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.select("node", "component").distinct().join(least, "component")
    out = rows.join(by_node, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row_key", "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id (and then row key); texts without words all stay once per row."""
    keyed = docs.withColumn("__key", key_string(docs))
    rows = link(docs)
    first = rows.where(F.col("n_shingles") > 0).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("row_key"))).alias("m")).select(F.col("m.row_key").alias("row_key"))
    gone = rows.where(F.col("n_shingles") > 0).select("row_key").distinct().join(first, "row_key", "left_anti").withColumnRenamed("row_key", "__key")
    kept = keyed.join(gone, "__key", "left_anti")
    return kept.dropDuplicates(["__key"]).drop("__key")
