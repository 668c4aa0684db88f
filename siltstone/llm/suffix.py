"""Removal of repeated long substrings with suffix arrays built by two-stage sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the input.
Shorter repeats, of ``LEAST`` bytes or more (a passage of some 50 words), are reported and not removed.
One suffix array of a corpus fits no machine, so the strings are first dealt into blocks that settle them
alone: of the ``GRAM``-byte grams of a string of LEAST bytes, the one with the least hash (the leftmost
of equals) is its anchor. Equal strings have equal anchors at equal places, whatever buffer they stand in. All strings
of a document that share an anchor form one *context*, the bytes from the first of their starts to LENGTH
bytes after the last (or the document's end). So each start is in one context, and starts of equal
strings meet in the block of their anchor's hash.

1. A scan finds the anchors and returns a row (anchor hash, hash of the context, place) for each, without
   text. Counts of anchors, partial on the map side, drop the many that occur once; then equal contexts are counted.
   Copies of a document, or thousands of pages with one passage, collapse here to one context with a weight.
2. The bytes of each distinct context left are dealt by anchor hash. A task concatenates the contexts
   of its anchors in blocks and builds the suffix array of each block: suffixes that are smaller than
   their successors are sorted directly, all others are induced from them by scanning the buckets of
   first bytes in ascending order. Adjacent suffixes with a common prefix of LEAST (LENGTH) bytes or more
   are runs; a run whose contexts weigh two or more in sum holds repeated strings.
3. The starts found are joined back to all places of their context, merged per document and cut out.

Nothing is capped. A context is known by two 64-bit hashes, its anchor's and its own. The group of one
anchor goes to one task and is held in memory: distinct contexts of one anchor, of some 500 bytes each. A
group beyond ``GROUP_BYTES`` is therefore dealt anew by narrower contexts: of at most ``NARROW``
neighbouring starts, keyed by the bytes that all of their strings share; strings that agree still meet, contexts
that differ in the shared bytes part, and equal ones collapse.

Edge cases: null or empty text has 0 bytes and nothing is removed; a text shorter than LENGTH bytes is
never touched, one shorter than LEAST never reported; rows that repeat are repeats of each other and are removed whole if long enough; bytes are
UTF-8 and may be cut within a character; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import native as N

LENGTH = 400
LEAST = 256
GRAM = 64
#: Low bits of a packed (hash, place); the same for all buffers, so that equal strings choose equal anchors.
PLACE_BITS = 31
BLOCK_BYTES = 1 << 19
GROUP_BYTES = 4 << 20
NARROW = 32
#: Rows of LENGTH bytes that one sort holds.
SORT_ROWS = 1 << 16
COUNTS = ("n_bytes", "n_removed", "n_spans", "n_repeated")


# --- the suffix array of a block ---------------------------------------------------------------


def _rows(view: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(view[at])


def sort_direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of text[at : at + depth]; text has depth bytes of padding."""
    if len(at) < 2:
        return at
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    lead = np.lib.stride_tricks.sliding_window_view(text, 8)[at].copy().view(">u8").ravel()
    order = np.argsort(lead, kind="stable")
    at, lead = at[order], lead[order]
    cut = np.flatnonzero(lead[1:] != lead[:-1]) + 1
    runs = np.concatenate([[0], cut, [len(at)]])
    size = np.diff(runs)
    several = np.flatnonzero(size > 1)
    out = at.copy()
    i = 0
    while i < len(several):
        j, total = i, 0
        while j < len(several) and (j == i or total + size[several[j]] <= SORT_ROWS):
            total += size[several[j]]
            j += 1
        place = np.concatenate([np.arange(runs[k], runs[k + 1]) for k in several[i:j].tolist()])
        rows = _rows(view, at[place]).view(f"S{depth}").ravel()
        # Runs differ in their first 8 bytes and stand in order, so that one sort keeps them apart.
        out[place] = at[place][np.argsort(rows, kind="stable")]
        i = j
    return out


def two_stage(text: np.ndarray, begin: np.ndarray, stop: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of many strings in the order of their first ``depth`` bytes.

    text: the strings (values 1..256, 0 between and after them, with depth zeros at the end);
    string k is text[begin[k]:end[k]] and the suffixes from begin[k] to stop[k] - 1 are wanted.
    Suffixes that agree in depth bytes are neighbours in the result."""
    n = int(end[-1]) + 1 if len(end) else 0
    t = text[:n].astype(np.int32)
    # smaller[i]: suffix i < suffix i + 1. In a run of equal bytes the byte after the run decides.
    step = np.sign(np.diff(t, append=-1))
    turn = np.flatnonzero(step)
    smaller = (step[turn] > 0)[np.searchsorted(turn, np.arange(n))]
    ends = np.zeros(n, bool)
    ends[end] = True
    smaller[ends] = True  # the end of a string is smaller than all and needs no sorting
    # Each wanted suffix is induced by its successor: take in all up to the next directly sorted one.
    direct = np.flatnonzero(smaller)
    last = direct[np.searchsorted(direct, stop - 1)]
    want = np.zeros(n + 1, np.int64)
    np.add.at(want, begin, 1)
    np.add.at(want, last + 1, -1)
    want = np.cumsum(want)[:n] > 0
    seeds = direct[want[direct]]
    closing = seeds[ends[seeds]]
    seeds = seeds[~ends[seeds]]
    seeds = sort_direct(text8(text), seeds, depth) if len(seeds) else seeds
    large = want & ~smaller
    out: list[np.ndarray] = []
    pending: list[list[np.ndarray]] = [[] for _ in range(258)]
    lead = t[seeds]
    first = np.searchsorted(lead, np.arange(259))

    def induce(scanned: np.ndarray, bucket: int) -> np.ndarray:
        """Predecessors of scanned suffixes, in order, to their buckets; those of this bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[large[before]]
        if not len(before):
            return before
        c = t[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        bounds = np.flatnonzero(c[1:] != c[:-1]) + 1
        same = np.zeros(0, np.int64)
        for part in np.split(before, bounds):
            b = int(t[part[0]])
            if b == bucket:
                same = part
            else:
                pending[b].append(part)
        return same

    induce(closing, 0)
    for bucket in range(1, 258):
        wave = np.concatenate(pending[bucket]) if pending[bucket] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, bucket)
        mine = seeds[first[bucket] : first[bucket + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, bucket)
    array = np.concatenate(out) if out else np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, stop, -1)
    return array[(np.cumsum(inside)[:n] > 0)[array]]


def text8(text: np.ndarray) -> np.ndarray:
    """Values 0..256 as bytes that sort alike wherever the strings compared are whole: 256 and 0 share a
    byte with their neighbours only beyond a string's end, where order is free."""
    return (np.maximum(text, 1) - 1).astype(np.uint8)


def repeated_starts(contexts: list[bytes], weights: np.ndarray, length: int = LENGTH, last: np.ndarray | None = None, least: int | None = None) -> tuple[np.ndarray, ...]:
    """(context, start) of each string of ``length`` bytes that occurs more than once in weight.

    ``last``: the last start wanted of each context, by default the last string's. With ``least``, strings of that many
    bytes count, and a third array tells those that are repeated over ``length`` bytes."""
    shortest = least or length
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    end = begin + sizes
    text = np.zeros(int(end[-1]) + 9 + length, np.int16)
    joined = np.frombuffer(b"\0".join(contexts), np.uint8)
    text[: len(joined)] = joined.astype(np.int16) + 1
    text[end] = 0
    stop = end - shortest + 1 if last is None else begin + last + 1
    array = two_stage(text, begin, stop, end, length)
    if not len(array):
        return (array, array, array.astype(bool)) if least else (array, array)
    owner = np.searchsorted(begin, array, "right") - 1
    again = _again(text, array, weights[owner], shortest)
    if not least:
        return owner[again], (array - begin[owner])[again]
    long = np.zeros(len(array), bool)
    # Strings that a document's end cuts short take no part in the longer runs.
    whole = np.flatnonzero(end[owner] - array >= length)
    long[whole] = _again(text, array[whole], weights[owner[whole]], length)
    return owner[again], (array - begin[owner])[again], long[again]


def _again(text: np.ndarray, array: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which of the sorted suffixes share ``length`` bytes with others, by their common prefixes with neighbours."""
    view = np.lib.stride_tricks.sliding_window_view(text8(text), length)
    new = np.ones(len(array), bool)
    for a in range(1, len(array), SORT_ROWS):
        b = min(a + SORT_ROWS, len(array))
        rows = _rows(view, array[a - 1 : b])
        differs = rows[1:] != rows[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
        new[a:b] = common < length
    run = np.cumsum(new) - 1
    return np.bincount(run, weights=weight)[run] > 1 if len(array) else new


# --- anchors -----------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of a text buffer: (row, gram hash, place of the gram, first start, last start)."""
    none = np.zeros(0, np.int64)
    n = len(data) - gram + 1
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none
    prefix = C.prefix_codes(data)
    at = np.arange(n)
    h = C.slice_hash(prefix, at, at + gram)
    del prefix
    low = PLACE_BITS
    packed = (h >> np.uint64(low) << np.uint64(low)) | at.astype(np.uint64)
    w = length - gram + 1
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(data) - length + 1
    place = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64((1 << low) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(m), "right") - 1
    ok = np.flatnonzero(np.arange(m) + length <= offsets[row + 1])
    if not len(ok):
        return none, none.astype(np.uint64), none, none, none
    place, row = place[ok], row[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(ok)]]) - 1
    return row[head], h[place[head]], place[head], ok[head], ok[tail]


def _places(docs: DataFrame, length: int, least: int) -> DataFrame:
    """(doc_id, th, a, c, at): contexts by the hashes of anchor and bytes; ``at`` packs the first start, the last one
    less the first, and the anchor's place less the first."""
    if length >= 1 << 16:
        raise ValueError("strings of 2**16 bytes or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch):
                data, offsets = C.flat(part.column(2))
                row, h, place, s, e = anchors(data, offsets, least)
                body = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                stop = np.minimum(e + length, offsets[row + 1])
                # The gram's place in the context is part of what must be equal.
                c = np.array([digest(body[a:b], p) for a, b, p in zip(s.tolist(), stop.tolist(), (place - s).tolist())], np.uint64)
                at = (s - offsets[row]) << 32 | (e - s) << 16 | (place - s)
                yield pa.record_batch(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(C.signed(h)), pa.array(C.signed(c)), pa.array(at)],
                    names=["doc_id", "th", "a", "c", "at"],
                )

    kind = T.StructType([docs.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in ("th", "a", "c", "at")]])
    return docs.where("text is not null").select(*N.row_key(), "text").mapInArrow(run, kind)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, least: int) -> DataFrame:
    """(k, a, c, off, last, weight, body): the bytes of the wanted contexts, wide ones as they are and those
    of a hot anchor cut into narrow ones. ``off`` is the place of body in its context, ``last`` its last start."""
    lists = wanted.groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.collect_list(F.struct("a", "c", "at", "weight", "hot")).alias("items"))
    keyed = docs.where("text is not null").select(*N.row_key(), "text")
    both = keyed.join(lists, keyed.doc_id.eqNullSafe(lists.k_id) & (keyed.th == lists.k_th)).select("text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, items in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                for x in items.as_py():
                    s = x["at"] >> 32
                    e, p = s + (x["at"] >> 16 & 0xFFFF), s + (x["at"] & 0xFFFF)
                    if not x["hot"]:
                        out.append((x["a"], x["a"], x["c"], 0, e - s, x["weight"], data[s : e + length]))
                        size += e - s + length
                        continue
                    # Narrow contexts: starts with p - start in one block of NARROW distances.
                    for block in range((p - e) // NARROW, (p - s) // NARROW + 1):
                        a, b = max(s, p - block * NARROW - NARROW + 1), min(e, p - block * NARROW)
                        core = data[p - block * NARROW : p - block * NARROW - NARROW + 1 + least]
                        key = xxhash.xxh3_64_intdigest(core, block)
                        out.append((key - (1 << 64) * (key >> 63), x["a"], x["c"], a - s, b - a, x["weight"], data[a : b + length]))
                        size += b - a + length
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return both.mapInArrow(run, "k long, a long, c long, off int, last int, weight long, body binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["k", "a", "c", "off", "last", "weight", "body"])


def _settle(contexts: DataFrame, length: int, least: int) -> DataFrame:
    """(a, c, x, y, long): ranges x..y of repeated starts in a context, over ``least`` or over ``length`` bytes."""

    def ranges(held: list[tuple], owner: np.ndarray, start: np.ndarray, long: bool) -> pa.RecordBatch:
        off = np.array([r[3] for r in held], np.int64)
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(owner)]]) - 1
        who = owner[head]
        a, c = np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64)
        return pa.record_batch([pa.array(a[who]), pa.array(c[who]), pa.array((start[head] + off[who]).astype(np.int32)), pa.array((start[tail] + off[who]).astype(np.int32)), pa.array(np.full(len(who), long))], names=["a", "c", "x", "y", "long"])

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        owner, start, long = repeated_starts([r[6] for r in held], np.array([r[5] for r in held], np.float64), length, np.array([r[4] for r in held], np.int64), least)
        for kind in (False, True):
            some = long if kind else np.ones(len(owner), bool)
            if some.any():
                yield ranges(held, owner[some], start[some], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal group, size
            # A single context that weighs one cannot hold a repeat of its own group.
            if len(group) > 1 or (group and group[0][5] > 1):
                held.extend(group)
                size += sum(len(r[6]) for r in group)
            group = []

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if group and r[:4] == group[-1][:4]:
                    continue  # rows of documents that repeat send their contexts again
                if group and r[0] != group[0][0]:
                    close()
                    if size >= BLOCK_BYTES:
                        yield from solve(held)
                        held, size = [], 0
                group.append(r)
        close()
        if held:
            yield from solve(held)

    return contexts.repartition("k").sortWithinPartitions("k", "a", "c", "off").mapInArrow(run, "a long, c long, x int, y int, long boolean")


def repeated(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES, *, least: int = LEAST) -> DataFrame:
    """(doc_id, th, ranges, weak): byte ranges (a, b) to remove, and those of the repeats of ``least`` bytes or
    more, of the rows that have any. ``least`` is at most ``length``."""
    least = min(least, length)
    places = C.materialise(_places(docs, length, least), "places")
    many = C.materialise(places.groupBy(F.col("a").alias("a2")).agg(F.count("*").alias("n")).where("n > 1").select("a2"), "anchors")
    # Both inputs are shuffles of their own, so that a hot anchor can be split.
    some = C.materialise(places.join(many, places.a == many.a2, "left_semi"), "shared")
    C.discard(places)
    C.discard(many)
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "at")).alias("rep")
    distinct = C.materialise(some.groupBy("a", "c").agg(F.count("*").alias("weight"), rep), "distinct")
    width = F.shiftright(F.col("rep.at"), 16).bitwiseAND(F.lit(0xFFFF))
    sums = distinct.groupBy("a").agg(F.sum(width + length).alias("bytes"))
    hot = C.materialise(sums.where(F.col("bytes") > group_bytes).select(F.col("a").alias("a2")), "hot")
    # Each hot anchor has group_bytes of distinct contexts or more.
    flagged = distinct.join(C.small_or_plain(hot, 8), distinct.a == hot.a2, "left")
    wanted = flagged.select("a", "c", "weight", F.col("a2").isNotNull().alias("hot"), "rep.doc_id", "rep.th", "rep.at")
    starts = C.materialise(_settle(_contexts(docs, wanted, length, least), length, least), "starts")
    lists = starts.groupBy(F.col("a").alias("d1"), F.col("c").alias("d2")).agg(F.collect_list(F.struct("x", "y", "long")).alias("xy"))
    # A table of its own: a join of two shuffles, of which large partitions can be split.
    lists = C.materialise(lists, "lists")
    for done in (distinct, hot, starts):
        C.discard(done)
    first = F.shiftright("at", 32)
    hit = some.join(lists, (some.a == lists.d1) & (some.c == lists.d2)).select("doc_id", "th", first.alias("s"), F.explode("xy").alias("r"))
    span = F.struct((F.col("s") + F.col("r.x")).alias("a"), (F.col("s") + F.col("r.y") + F.when(F.col("r.long"), length).otherwise(least)).alias("b"))
    hit = hit.select("doc_id", "th", span.alias("span"), "r.long")
    return hit.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.when(F.col("long"), F.col("span")))).alias("ranges"), F.array_sort(F.collect_set(F.when(~F.col("long"), F.col("span")))).alias("weak"))


def _cut(data: bytes, ranges: list[dict]) -> tuple[int, int, list[bytes]]:
    kept, removed, spans, at, reach = [], 0, 0, 0, -1
    for r in ranges:
        a, b = r["a"], r["b"]
        if a > reach:
            spans += 1
            kept.append(data[at:a])
        if b > reach:
            removed += b - max(a, reach, 0) if a <= reach else b - a
            reach = at = max(reach, b)
    kept.append(data[at:])
    return removed, spans, kept


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_repeated, kept) of every row; kept is binary: a cut may split a
    character. n_repeated: bytes covered by a repeat of LEAST bytes or more, removed or not."""
    gone = repeated(docs, length).withColumnsRenamed({"doc_id": "k_id", "th": "k_th"})
    keyed = docs.select(*N.row_key(), "text")
    both = keyed.join(gone, keyed.doc_id.eqNullSafe(gone.k_id) & keyed.th.eqNullSafe(gone.k_th), "left").select("doc_id", "text", "ranges", "weak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch):
                rows = []
                for text, ranges, weak in zip(part.column(1), part.column(2), part.column(3)):
                    data = (text.as_py() or "").encode()
                    removed, spans, kept = _cut(data, ranges.as_py() or [])
                    rows.append((len(data), removed, spans, _cut(data, weak.as_py() or [])[0], b"".join(kept)))
                cols = list(zip(*rows))
                yield pa.record_batch([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["doc_id", *COUNTS, "kept"])

    kind = T.StructType([docs.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in COUNTS], T.StructField("kept", T.BinaryType())])
    return both.mapInArrow(run, kind)


def digest(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
