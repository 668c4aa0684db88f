"""SimHash near-duplicate groups through BK-trees.

A fingerprint has 64 bits: bit i is set if more than half of the document's 4-word shingles have it
set in their XXH64 (seed 42). Distinct fingerprints are cut into ``BLOCKS`` bit blocks. Two that differ
in at most ``RADIUS`` bits agree on at least BLOCKS - RADIUS blocks, so that each combination of that
many blocks names a shard, and each linked pair meets in at least one shard. In a shard the
fingerprints form a BK-tree (children keyed by their integer Hamming distance to the parent) and each
member queries it, following only the edges within the radius. Trees are sent to their queries through
the shuffle and not through the driver, whose memory has a bound that the corpus has not.

Hot shards: beyond ``SHARD_LIMIT`` members a shard becomes several trees, each queried by all members
in blocks; no pair is lost. A shard returns a spanning star for each of its groups and never its pairs.

Edge cases: null or empty text has fingerprint zero; zero fingerprints link like any others; repeated
rows are rows of one group; a null doc_id gets a row and never names a component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
SHARD_LIMIT = 20_000
#: Frontier entries (query, node) that one step of a tree search holds.
FRONTIER = 1 << 20


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of one text (UTF-8)."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(x.as_py() or b"") for x in texts]
            yield pa.record_batch([batch.column(0), pa.array(C.signed(np.array(found, np.uint64)))], names=["doc_id", "fp"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return C.text_frame(docs).mapInArrow(run, kind)


# --- BK-trees ----------------------------------------------------------------------------------


class Forest:
    """BK-trees of many shards in one set of arrays, built and searched level by level.

    ``values`` holds the members, ``shard`` the (sorted) shard of each; members of a shard differ.
    Node i's children are ``child[first[i]:first[i+1]]`` with edge labels ``edge`` in ascending order."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values
        new = np.ones(n, bool)
        new[1:] = shard[1:] != shard[:-1]
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        parents, labels, nodes = [], [], []
        item = np.flatnonzero(~new)
        at = self.root[item]
        while len(item):
            d = np.bitwise_count(values[item] ^ values[at]).astype(np.int64)
            key = at * 65 + d
            _, lead, group = np.unique(key, return_index=True, return_inverse=True)
            head = item[lead]
            parents.append(at[lead]), labels.append(d[lead]), nodes.append(head)
            rest = np.ones(len(item), bool)
            rest[lead] = False
            item, at = item[rest], head[group[rest]]
        parent = np.concatenate([*parents, np.zeros(0, np.int64)])
        label = np.concatenate([*labels, np.zeros(0, np.int64)])
        order = np.lexsort((label, parent))
        self.child = np.concatenate([*nodes, np.zeros(0, np.int64)])[order]
        self.key = parent[order] * 65 + label[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of query, node) within the radius, in blocks of bounded size."""
        stack = [(np.arange(a, min(a + FRONTIER // 8, len(queries))), roots[a : a + FRONTIER // 8]) for a in range(0, len(queries), FRONTIER // 8)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
            total = int(count.sum())
            if total:
                step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                stack.append((np.repeat(q, count), self.child[np.repeat(low, count) + step]))


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the groups of a[i] and b[i]; a label is its group's smallest index."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def star_links(shard: np.ndarray, values: np.ndarray, is_tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (value, smallest-indexed value of its group) over rows sorted by shard; rows that
    are tree members form the trees, all rows query the tree of their shard."""
    tree = np.flatnonzero(is_tree)
    forest = Forest(values[tree], shard[tree])
    at = np.searchsorted(shard[tree], shard)
    labels = np.arange(len(values))
    ok = np.flatnonzero((at < len(tree)) & (shard[tree][np.minimum(at, max(len(tree) - 1, 0))] == shard)) if len(tree) else np.zeros(0, np.int64)
    for q, node in forest.search(values[ok], at[ok], radius):
        labels = merge(labels, ok[q], tree[node])
    other = np.flatnonzero((labels != np.arange(len(values))) & (values != values[labels]))
    return values[other], values[labels[other]]


def block_keys(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One mask of kept bits for each combination of blocks - radius blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(x) - (1 << 64) * (sum(x) >= 1 << 63) for x in combinations(masks, blocks - radius)]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Edges (a, b) that span every group of linked fingerprints in ``distinct`` (column fp)."""
    masks = block_keys(blocks, radius)
    rows = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("band", "mask"))
    rows = rows.select("fp", "band", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    sizes = rows.groupBy("band", "part").agg(F.count("*").alias("size")).where(F.col("size") > shard_limit)
    sizes = sizes.select(F.col("band").alias("b2"), F.col("part").alias("p2"), F.ceil(F.col("size") / shard_limit).cast("int").alias("trees"))
    sizes = C.small_or_plain(C.materialise(sizes, "hot"), 32)
    rows = rows.join(sizes, (rows.band == sizes.b2) & (rows.part == sizes.p2), "left")
    trees = F.coalesce("trees", F.lit(1))
    rows = rows.select("fp", F.pmod(F.xxhash64("fp"), trees).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("other"), "band", "part")
    # Of a hot shard, each pair of blocks is a task: the lower block is its tree, both query it.
    rows = rows.select(F.xxhash64("band", "part", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp", (F.col("own") <= F.col("other")).alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                if sum(x.num_rows for x in held) < 1 << 19:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            shard = table["shard"].to_numpy()
            stop = len(shard) if batch is None else int(np.searchsorted(shard, shard[-1]))
            if stop == 0:
                continue
            fp, member = table["fp"].to_numpy().view(np.uint64), table["member"].to_numpy()
            _, first, size = np.unique(shard[:stop], return_index=True, return_counts=True)
            some = np.repeat(size > 1, size)
            a, b = star_links(shard[:stop][some], fp[:stop][some], member[:stop][some], radius)
            if len(a):
                yield pa.record_batch([pa.array(C.signed(a)), pa.array(C.signed(b))], names=["a", "b"])
            held = table.slice(stop).to_batches()

    # A 64-bit shard key may in theory merge two shards; a merged shard still links only true pairs.
    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def groups(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = C.materialise(fingerprints(docs), "fingerprints")
    distinct = C.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = C.components(links(distinct.select("fp"), radius, blocks, shard_limit))
    linked = C.materialise(found.where("node is not null"), "linked")
    named = linked.join(distinct, linked.node == distinct.fp).groupBy("root").agg(F.min("least").alias("low"))
    named = linked.join(named, "root").select(F.col("node").alias("fp2"), "low")
    final = distinct.join(named, distinct.fp == named.fp2, "left").select(F.col("fp").alias("fp3"), F.coalesce("low", "least").alias("component_id"))
    return prints.join(final, prints.fp == final.fp3).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs less all but one of each group: the row with the smallest doc_id stays, and of
    rows that repeat it the one whose text has the smallest hash. A row without doc_id stays."""
    keep = groups(docs, radius).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    stay = docs.join(keep, docs.doc_id == keep._keep, "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = stay.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")
    return first.unionByName(docs.where("doc_id is null"))
