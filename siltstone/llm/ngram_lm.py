"""N-gram language model in an Elias-Fano trie; scores of whole texts.

Level 1 holds the words: frequent ones (``MIN_COUNT`` or more) and rare ones, each in the order of 64-bit
hashes, with exact counts as monotone sums. Level n holds the n-grams that occur MIN_COUNT times or more,
below their first n - 1 words. The words below one node are ascending; each is stored relative to its
context: at level 3 a word is its rank among the successors of the n-gram's middle word, so that it needs
few bits. Adding the last value of the range before makes a level's words one monotone sequence, Elias-Fano
coded like the pointers to ranges and the counts. Probabilities and back-off weights are quantised to 8
bits of log10.

Look-ups of a piece of text are sorted and walk the mapped files once: pointers come from select, the word
from a successor search for its value within the range of its context. Nothing is unpacked but the segments
that many look-ups share, one at a time (``elias``); a worker keeps file handles, not contents.

Probabilities: p1(w) = (c + 0.1) / (N + 0.1 (V + 1)); p_n(w | h) = (c(hw) - D) / c(h) + b(h) p_{n-1}(w | h')
for stored n-grams, else b(h) p_{n-1}(w | h'), where b(h) is what the stored ones leave. So each p sums to
one over the vocabulary and one unknown word.

Everything is counted over all training texts. An n-gram occurs at most as often as its parts: level n
counts only candidates whose parts are stored, which prunes without error. MIN_COUNT is a parameter;
with 1 every n-gram is stored. Words become ids once; the id table is written to the shared folder and read
by the later steps. N-grams are counted in two steps: a task sorts those of a piece of text, merges equal
ones and deals them in packed runs to buckets of their hashes; a bucket merges its runs. A level is then
sorted by key over all tasks, so that a context of any size is cut across shards of about ``SHARD`` entries.
The driver sees one manifest row a shard, and adds up the contexts that shards share.

Edge cases: null or empty text is the end token alone; a null doc_id has the remainder of the empty text;
without training texts all probabilities are that of the unknown word; repeated rows are learned and scored
row by row; an empty table gives no rows; extra columns are ignored. A text of more than 2**29 words (over
1 GB) raises ValueError, as its ids fit no binary value; so do 2**32 - 2 frequent words.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import elias

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.75
ALPHA = 0.1
FOLDS = 10
SHARD = 1 << 20
#: Bytes of text, and words of numbered texts, that a task handles at once (one text at least).
PIECE_BYTES = 4 << 20
PIECE_WORDS = 2 << 20
#: Words of training text for each counting bucket.
BUCKET_WORDS = 2 << 20
#: Steps of a quantised log10: 255 stands for -12.75 and below.
STEP = 0.05
#: Files that a worker keeps mapped.
OPEN_FILES = 512
#: Ids of words that the training texts do not have, and of those too rare for n-grams.
NONE = np.uint32(0xFFFFFFFF)
RARE = np.uint32(0xFFFFFFFE)
END_CODE = np.uint64(0x51E57011E0000001)
TOP = np.uint64(1 << 63)
_OPEN: OrderedDict[str, list[np.ndarray]] = OrderedDict()


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 255).astype(np.uint8)


def ordered(x: np.ndarray) -> np.ndarray:
    """Signed longs in the order of the unsigned ones, and back."""
    return (x.astype(np.uint64) ^ TOP).view(np.int64)


def unordered(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64) ^ TOP


# --- files -------------------------------------------------------------------------------------


def pack(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return head + b"".join(p + bytes(-len(p) % 8) for p in parts)


def parts_of(uri: str) -> list[np.ndarray]:
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri]
    data = C.mapped(uri)
    n = int(np.frombuffer(bytes(data[:8]), "<u8")[0])
    sizes = np.frombuffer(bytes(data[8 : 8 + 8 * n]), "<u8").astype(np.int64)
    ends = 8 + 8 * n + np.cumsum((sizes + 7) // 8 * 8)
    _OPEN[uri] = [data[e - (s + 7) // 8 * 8 : e - (s + 7) // 8 * 8 + s] for s, e in zip(sizes.tolist(), ends.tolist())]
    if len(_OPEN) > OPEN_FILES:
        _OPEN.popitem(last=False)
    return _OPEN[uri]


def sequences(uri: str, n: int) -> list[elias.EliasFano]:
    return [elias.EliasFano(x) for x in parts_of(uri)[:n]]


class Words:
    """Level 1. ``shards``: (rare, lowest hash, uri, base, n) in order; ids of frequent words are bases plus ranks."""

    def __init__(self, shards: list[tuple], total: int, distinct: int, frequent: int):
        if frequent >= int(RARE):
            raise ValueError("more than 2**32 - 3 frequent words")
        self.shards, self.total, self.distinct, self.frequent = shards, total, distinct, frequent

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct ascending codes; unknown words count 0."""
        ids, counts = np.full(len(codes), NONE, np.uint32), np.zeros(len(codes), np.int64)
        for kind in (0, 1):
            own = [s for s in self.shards if s[0] == kind]
            cuts = np.append(np.searchsorted(codes, np.array([s[1] for s in own], np.uint64)), len(codes))
            for (_, low, uri, base, n), a, b in zip(own, cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                values, sums = sequences(uri, 2)
                want = codes[a:b] - np.uint64(low)
                at, value = values.successor(want)
                hit = np.flatnonzero((at < n) & (value == want))
                at = at[hit]
                ids[a + hit] = RARE if kind else (base + at).astype(np.uint32)
                counts[a + hit] = (sums.take(at + 1) - sums.take(at)).astype(np.int64)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids of frequent words."""
        return gather([(s[2], s[3], s[4], 1) for s in self.shards if not s[0]], ids)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ALPHA) / (self.total + ALPHA * (self.distinct + 1))


def gather(shards: list[tuple], at: np.ndarray) -> np.ndarray:
    """Counts of ascending entries; shards: (uri, base, n, number of the part that holds the sums)."""
    out = np.zeros(len(at), np.int64)
    cuts = np.searchsorted(at, [*[s[1] for s in shards], shards[-1][1] + shards[-1][2]] if shards else [0])
    for (uri, base, _, part), a, b in zip(shards, cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            sums, own = elias.EliasFano(parts_of(uri)[part]), at[a:b] - base
            out[a:b] = (sums.take(own + 1) - sums.take(own)).astype(np.int64)
    return out


class Level:
    """Level 2 or higher: the n-grams by key, which is (parent << bits) + word.

    ``shards``: (route, uri, weights, base, n, first parent, last parent, lead), by key. Keys from route on are
    looked up in the shard; ``lead`` entries of its first parent stand in shards before. A shard's parts are
    the pointers of its parents, monotone words and monotone counts; its weights are the quantised
    probabilities and the quantised back-off weights of its parents."""

    def __init__(self, shards: list[tuple], bits: int, most: int):
        #: ``most``: the entries of the parent that has most.
        self.shards, self.bits, self.most = shards, bits, most
        self.route = np.array([s[0] for s in shards], np.uint64)
        self.nodes = shards[-1][3] + shards[-1][4] if shards else 0

    def find(self, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each of the distinct ascending keys: the node (-1: not stored), its rank below the parent, its
        probability and its parent's back-off weight (both quantised)."""
        n = len(key)
        node, rank = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        prob, off = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        cuts = np.append(np.searchsorted(key, self.route), n)
        for (_, uri, weights, base, size, first, last, lead), a, b in zip(self.shards, cuts[:-1].tolist(), cuts[1:].tolist()):
            # Keys beyond the last parent have parents without entries.
            b = a + int(np.searchsorted(key[a:b], np.uint64((last + 1) << self.bits)))
            if a == b:
                continue
            pointer, words = sequences(uri, 2)
            probs, offs = parts_of(weights)
            here = (key[a:b] >> np.uint64(self.bits)).astype(np.int64) - first
            new = np.ones(b - a, bool)
            new[1:] = here[1:] != here[:-1]
            parent, of = here[new], np.cumsum(new) - 1
            off[a:b] = offs[here]
            x, y = pointer.take(parent).astype(np.int64), pointer.take(parent + 1).astype(np.int64)
            some = np.flatnonzero(y > x)
            before, top = np.zeros(len(parent), np.uint64), np.zeros(len(parent), np.uint64)
            inner = some[x[some] > 0]
            before[inner] = words.take(x[inner] - 1)
            top[some] = words.take(y[some] - 1)
            ask = np.flatnonzero((y > x)[of])
            to = of[ask]
            want = (key[a:b][ask] & np.uint64((1 << self.bits) - 1)) + before[to] + np.uint64(1)
            # No word of the range is beyond its top; held there, the wanted values stay ascending.
            at, value = words.successor(np.minimum(want, top[to] + np.uint64(1)))
            hit = (value == want) & (at < y[to])
            ask, at, to = ask[hit], at[hit], to[hit]
            node[a + ask] = base + at
            rank[a + ask] = at - x[to] + np.where(parent[to] == 0, lead, 0)
            prob[a + ask] = probs[at]
        return node, rank, prob, off

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        """Counts of ascending nodes."""
        return gather([(s[1], s[3], s[4], 2) for s in self.shards], nodes)


# --- training ----------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def coded(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens (words and an end for each row) and the rows' first tokens."""
    data, offsets = C.flat(part.column(column))
    low = C.LOWER[data]
    start, end, first = C.word_bounds(low, offsets)
    codes = C.slice_hash(C.prefix_codes(low), start, end)
    at = first + np.arange(len(first))
    out = np.full(at[-1], END_CODE, np.uint64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(codes)) + row] = codes
    return out, at


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(key)))


def _sorted_shards(rows: DataFrame, order: list[str], build: Callable, folder: str, kind: str) -> list:
    """Sort rows of distinct keys over all tasks and write ``build(columns) -> (payload, tell)`` of each
    range of about SHARD rows. Returns the manifest rows (tell..., uri, n), one a shard."""
    schema = pa.schema([("tell", pa.list_(pa.int64())), ("uri", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            payload, tell = build({c: table[c].to_numpy() for c in table.column_names})
            uri = f"{folder}/{kind}-{uuid.uuid4().hex}"
            C.put(uri, payload)
            yield pa.record_batch([[tell], [uri], [table.num_rows]], schema=schema)

    dealt = rows.repartitionByRange(max(1, -(-rows.count() // SHARD)), *order).sortWithinPartitions(*order)
    told = C.materialise(dealt.mapInArrow(run, "tell array<long>, uri string, n long"), kind)
    out = sorted((tuple(r.tell), r.uri, r.n) for r in told.collect())
    C.discard(told)
    return out


def learn_words(docs: DataFrame, folder: str, min_count: int = MIN_COUNT) -> Words:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        for batch in batches:
            for part in C.pieces(batch, limit=PIECE_BYTES):
                codes = np.sort(coded(part, part.schema.get_field_index("text"))[0])
                head, c = runs(codes)
                yield pa.record_batch([pa.array(ordered(codes[head])), pa.array(c)], names=["h", "c"])

    counts = C.materialise(docs.where(~held_out()).select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    told = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") >= min_count).alias("f")).first()

    def build(t: dict) -> tuple[bytes, list[int]]:
        code = unordered(t["h"])
        return pack([elias.encode(code - code[0]), elias.encode(np.concatenate([[0], np.cumsum(t["c"])]))]), [int(t["h"][0])]

    shards = []
    for kind, some in enumerate((F.col("c") >= min_count, F.col("c") < min_count)):
        base = 0
        for tell, uri, n in _sorted_shards(counts.where(some), ["h"], build, folder, "words"):
            shards.append((kind, tell[0] + (1 << 63), uri, base, n))
            base += n
    C.discard(counts)
    return Words(shards, told.n or 0, told.v, told.f)


def number(docs: DataFrame, words: Words) -> DataFrame:
    """(doc_id, held, ids, unit, n_tokens, n_known, base_score) of every row; ids are packed 4-byte ids, unit
    the quantised probability of each word alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        for batch in batches:
            for part in C.pieces(batch, limit=PIECE_BYTES):
                codes, at = coded(part, 2)
                if len(codes) >= 1 << 29:
                    raise ValueError("a text of more than 2**29 words")
                distinct, back = np.unique(codes, return_inverse=True)
                ids_of, counts = words.look(distinct)
                p = words.p(counts)
                logs, ids, unit = np.log10(p), ids_of[back], quantise(p)[back]
                known = C.row_sums((counts > 0)[back], at)
                sums = np.add.reduceat(logs[back], at[:-1]) if len(at) > 1 else np.zeros(0)
                packed = [pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (ids, unit)]
                yield pa.record_batch([part.column(0), part.column(1), *packed, pa.array(np.diff(at)), pa.array(known), pa.array(sums)], names=["doc_id", "held", "ids", "unit", "n_tokens", "n_known", "base_score"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("held", T.BooleanType()), T.StructField("ids", T.BinaryType()), T.StructField("unit", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType())])
    return docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, kind)


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and its offsets."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def id_pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, first id of each row, whether id i and i + 1 are of one row)."""
    for part in C.pieces(batch, batch.schema.names[column], PIECE_WORDS * 4):
        data, o = binary(part.column(column))
        ids, o = data.view(np.uint32), o // 4
        joined = np.ones(len(ids), bool)
        joined[o[1:] - 1] = False
        yield part, ids, o, joined


def look(level: Level, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """``level.find`` of keys in any order and number."""
    order = np.argsort(key)
    key = key[order]
    head, size = runs(key)
    out = []
    for x in level.find(key[head]):
        y = np.empty(len(key), x.dtype)
        y[order] = np.repeat(x, size)
        out.append(y)
    return tuple(out)


def pair_nodes(level: Level, frequent: int, ids: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level-2 look-up of each id and the next one: node, rank, probability, back-off (0 where none)."""
    n = len(ids)
    node, rank = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    prob, off = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    i = np.flatnonzero(joined & (ids < frequent))
    if len(i):
        node[i], rank[i], prob[i], off[i] = look(level, ids[i].astype(np.uint64) << np.uint64(32) | ids[i + 1])
    return node, rank, prob, off


# --- counting n-grams --------------------------------------------------------------------------


def pack_run(key: np.ndarray, count: np.ndarray, extra: np.ndarray) -> bytes:
    """Ascending keys with counts and a byte each: differences by byte planes, which compress well."""
    planes = np.ascontiguousarray(np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    small = np.minimum(count, 255).astype(np.uint8)
    return np.array([len(key)], "<u8").tobytes() + planes.tobytes() + small.tobytes() + extra.tobytes() + count[count >= 255].astype("<i8").tobytes()


def unpack_run(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(body, np.uint8, 8 * n, 8).reshape(8, n)
    key = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    count = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(np.int64)
    count[count == 255] = np.frombuffer(body, "<i8", offset=8 + 10 * n)
    return key, count, np.frombuffer(body, np.uint8, n, 8 + 9 * n)


def count_keys(ids: DataFrame, keys: Callable, buckets: int, min_count: int) -> DataFrame:
    """(k, c, q): the keys that occur min_count times or more. ``keys(ids, joined) -> (key, byte)`` gives the
    occurrences of a piece; equal keys have equal bytes. k is in the order of ``ordered``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        for batch in batches:
            for _, x, _, joined in id_pieces(batch, 0):
                key, extra = keys(x, joined)
                order = np.argsort(key)
                key, extra = key[order], extra[order]
                head, count = runs(key)
                key, extra = key[head], extra[head]
                bucket = (C.mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts)).tolist()
                for at in range(0, len(some), 64):
                    own = some[at : at + 64]
                    bodies = [pack_run(key[i], count[i], extra[i]) for i in (order[cuts[b] : cuts[b + 1]] for b in own)]
                    yield pa.record_batch([pa.array(own, pa.int64()), pa.array(bodies, pa.binary())], names=["b", "body"])

    def close(bodies: list[bytes]) -> pa.RecordBatch:
        parts = [unpack_run(x) for x in bodies]
        key, count, extra = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        head, _ = runs(key)
        count = np.add.reduceat(count[order], head)
        keep = count >= min_count
        return pa.record_batch([pa.array(ordered(key[head][keep])), pa.array(count[keep]), pa.array(extra[order[head]][keep].astype(np.int16))], names=["k", "c", "q"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        held: list[bytes] = []
        bucket = -1
        for batch in batches:
            for b, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket and held:
                    yield close(held)
                    held = []
                bucket = b
                held.append(body.as_py())
        if held:
            yield close(held)

    dealt = ids.where("not held").select("ids").mapInArrow(deal, "b long, body binary")
    return dealt.repartition(buckets, "b").sortWithinPartitions("b").mapInArrow(merge, "k long, c long, q short")


def _level(ids: DataFrame, keys: Callable, bits: int, buckets: int, min_count: int, lower: Callable, parents: Callable, folder: str, kind: str) -> Level:
    """Count, sort and write a level. ``lower(words, bytes)`` gives p_{n-1} of entries, ``parents(nodes)`` the counts of ascending parents."""
    counted = C.materialise(count_keys(ids, keys, buckets, min_count), kind)
    mask = np.uint64((1 << bits) - 1)

    def build(t: dict) -> tuple[bytes, list[int]]:
        key, count = unordered(t["k"]), t["c"]
        parent, word = (key >> np.uint64(bits)).astype(np.int64), key & mask
        first, last = int(parent[0]), int(parent[-1])
        pointer = np.searchsorted(parent, np.arange(first, last + 2))
        # A value is one more than the word plus the last value of the range before it.
        head, size = runs(parent)
        tops = np.cumsum(word[head + size - 1] + np.uint64(1))
        values = word + np.uint64(1) + np.repeat(np.concatenate([np.zeros(1, np.uint64), tops[:-1]]), size)
        sums = np.concatenate([[0], np.cumsum(count)])
        a, z = int(size[0]), int(size[-1])
        tell = [int(t["k"][0]), first, last, a, int(count[:a].sum()), z, int(count[-z:].sum()), int(size.max())]
        return pack([elias.encode(pointer), elias.encode(values), elias.encode(sums), t["q"].astype(np.uint8).tobytes()]), tell

    # One row a shard. Entries and counts of the parents at shard ends are summed over shards.
    found = _sorted_shards(counted, ["k"], build, folder, kind)
    C.discard(counted)
    entries: dict[int, list[int]] = {}
    for (_, first, last, a, ca, z, cz, _), _, _ in found:
        for parent, n, c in [(first, a, ca), (last, z, cz)][: 1 + (first != last)]:
            own = entries.setdefault(parent, [0, 0])
            own[0] += n
            own[1] += c
    rows = [(i, uri, n, tell[1], tell[2], *entries[tell[1]], *entries[tell[2]]) for i, (tell, uri, n) in enumerate(found)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        for batch in batches:
            for i, uri, n, first, last, na, ca, nz, cz in zip(*[c.to_pylist() for c in batch.columns]):
                pointer, values, sums = (e.decode() for e in sequences(uri, 3))
                size = np.diff(pointer.astype(np.int64))
                some = np.flatnonzero(size)
                begin = pointer[:-1].astype(np.int64)[some]
                whole = np.zeros(last - first + 1)
                whole[some] = parents(first + some)
                before = np.repeat(values[np.maximum(begin, 1) - 1] * (begin > 0), size[some])
                p1 = lower(values - before - np.uint64(1), parts_of(uri)[3])
                parent = np.repeat(np.arange(last - first + 1), size)
                count = np.diff(sums.astype(np.int64))
                taken = np.bincount(parent, weights=count - DISCOUNT, minlength=last - first + 1)
                taken[0], taken[-1] = ca - DISCOUNT * na, cz - DISCOUNT * nz
                back = 1 - taken / np.maximum(whole, 1)
                p = (count - DISCOUNT) / whole[parent] + back[parent] * p1
                out = f"{folder}/weights-{uuid.uuid4().hex}"
                C.put(out, pack([quantise(p).tobytes(), quantise(back).tobytes()]))
                yield pa.record_batch([[i], [out]], names=["i", "weights"])

    spark = ids.sparkSession
    todo = spark.createDataFrame(rows, "i long, uri string, n long, first long, last long, na long, ca long, nz long, cz long").repartition(max(1, len(rows)), "i")
    told = C.materialise(todo.mapInArrow(weigh, "i long, weights string"), kind) if rows else None
    weights = {r.i: r.weights for r in told.collect()} if rows else {}
    shards, base, lead = [], 0, 0
    for i, (tell, uri, n) in enumerate(found):
        first, last, z = tell[1], tell[2], tell[5]
        lead = lead if i and first == found[i - 1][0][2] else 0
        # The first key of a parent that begins here is any word below it.
        route = tell[0] + (1 << 63) if lead else first << bits
        shards.append((route, uri, weights[i], base, n, first, last, lead))
        base += n
        lead = z + (lead if first == last else 0)
    return Level(shards, bits, max([tell[7] for tell, _, _ in found] + [n for n, _ in entries.values()], default=0))


def learn_pairs(ids: DataFrame, words: Words, folder: str, buckets: int, min_count: int) -> Level:
    frequent = words.frequent

    def keys(x: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = x < frequent
        i = np.flatnonzero(joined[:-1] & some[:-1] & some[1:]) if len(x) else np.zeros(0, np.int64)
        return x[i].astype(np.uint64) << np.uint64(32) | x[i + 1], np.zeros(len(i), np.uint8)

    def lower(word: np.ndarray, _) -> np.ndarray:
        own, back = np.unique(word.astype(np.int64), return_inverse=True)
        return words.p(words.counts(own))[back]

    return _level(ids, keys, 32, buckets, min_count, lower, words.counts, folder, "pairs")


def learn_triples(ids: DataFrame, words: Words, pairs: Level, folder: str, buckets: int, min_count: int) -> Level:
    """Level 3: parents are the nodes of level 2, words are ranks below the middle word."""
    bits = max(1, pairs.most.bit_length())
    if pairs.nodes.bit_length() + bits > 64:
        raise ValueError("level 3 needs keys of more than 64 bits")

    def keys(x: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, rank, prob, _ = pair_nodes(pairs, words.frequent, x, joined)
        i = np.flatnonzero((node[:-1] >= 0) & (node[1:] >= 0)) if len(x) else np.zeros(0, np.int64)
        return node[i].astype(np.uint64) << np.uint64(bits) | rank[i + 1].astype(np.uint64), prob[i + 1]

    def lower(_, q: np.ndarray) -> np.ndarray:
        return 10 ** (-STEP * q.astype(float))

    return _level(ids, keys, bits, buckets, min_count, lower, pairs.counts, folder, "triples")


class Model:
    def __init__(self, words: Words, pairs: Level | None, triples: Level | None):
        self.words, self.pairs, self.triples = words, pairs, triples

    def log_probs(self, ids: np.ndarray, unit: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """log10 p of each token, given the tokens of its row before it."""
        out = -STEP * unit
        if self.pairs is None or len(ids) < 2:
            return out
        node, rank, prob, off = pair_nodes(self.pairs, self.words.frequent, ids, joined)
        hit = node >= 0
        i = np.flatnonzero(joined)
        out[i + 1] = np.where(hit[i], -STEP * prob[i], out[i + 1] - STEP * off[i])
        if self.triples is None:
            return out
        i = np.flatnonzero(hit[:-1] & joined[1:])
        if len(i):
            bits = self.triples.bits
            # Words that do not follow the middle word cannot be stored: any rank beyond all serves.
            want = np.where(hit[i + 1], rank[i + 1], (1 << bits) - 1)
            found, _, p3, off3 = look(self.triples, node[i].astype(np.uint64) << np.uint64(bits) | want.astype(np.uint64))
            out[i + 2] = np.where(found >= 0, -STEP * p3, out[i + 2] - STEP * off3)
        return out


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None, min_count: int | None = None) -> tuple[Model, DataFrame]:
    """The model of the training rows, and the id table of all rows. With ``min_count`` 1 all n-grams are stored."""
    folder = folder or C.fresh_path(docs.sparkSession, "trie")
    least = MIN_COUNT if min_count is None else min_count
    words = learn_words(docs, folder, least)
    ids = C.materialise(number(docs, words), "ids")
    buckets = max(1, -(-words.total // BUCKET_WORDS))
    pairs = learn_pairs(ids, words, folder, buckets, least) if order > 1 and words.frequent else None
    triples = learn_triples(ids, words, pairs, folder, buckets, least) if order > 2 and pairs and pairs.nodes else None
    return Model(words, pairs, triples if triples and triples.nodes else None), ids


def score(model: Model, ids: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    total = model.words.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        for batch in batches:
            for part, x, first, joined in id_pieces(batch, 2):
                logs = model.log_probs(x, binary(part.column(3))[0], joined)
                sums = np.add.reduceat(logs, first[:-1])
                yield pa.record_batch([part.column(0), part.column(1), part.column(4), part.column(5), pa.array(np.full(part.num_rows, total, np.int64)), part.column(6), pa.array(sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = T.StructType([ids.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return ids.mapInArrow(run, kind)


def digest(docs: DataFrame) -> DataFrame:
    return score(*train(docs))
