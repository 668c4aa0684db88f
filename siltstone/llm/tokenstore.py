"""Token-id shards with Elias-Fano document boundaries.

A shard file is: magic, length of a JSON head, the head, the Elias-Fano sequence of document ends (one
more than documents: the first is 0), the Elias-Fano sequence of doc_ids less their smallest, and the
concatenated ids (2 bytes each where the vocabulary allows it, else 4). A document's range comes from
two selects. Documents go to shards by ranges of (doc_id, hash of the text), so that shard order and
order within shards are ascending doc_id; the start of a shard is the sum of the tokens before it,
known from the manifest, a table of one row a shard that is never gathered.

Executors write shards to the shared folder under names that no other attempt uses, and report them
through the manifest's own committed write: a lost or repeated task leaves an unlisted file at worst.

Edge cases: null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id
are ordered by the text's hash; an empty table gives no shard and no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import elias

MAGIC = b"STOK"
END_ID = 0
#: A task starts another shard file beyond this many ids, which bounds its memory.
SHARD_IDS = 1 << 22
#: Parts whose shards one window numbers.
PART_BLOCK = 4096
MANIFEST = "shard long, part long, uri string, documents long, tokens long, start long"
#: Pieces of a generation; a worker remembers the ids of two.
CACHE_WORDS = 300_000

_ENCODERS: dict[str, Encoder] = {}


class Pieces(dict):
    """Ids of pieces; a piece that is asked for and not known is learned."""

    def __init__(self, learn: Callable[[str], bytes | None]):
        self.learn = learn

    def __missing__(self, piece: str) -> bytes | None:
        return self.learn(piece)


class Encoder:
    """Ids of whole texts for a byte-level BPE file, equal to the library's encode().

    The pre-tokeniser always cuts before a single space that stands between two characters other than
    white space, and around a single line feed there. So such pieces are encoded one by one, each once
    for as long as it is remembered: until CACHE_WORDS others twice over were learned since its last use. Any other white space sends the text through encode() as it is, and
    so does the content of an added token, which the library finds before it cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        rule = json.loads(self.tokenizer.to_str())
        pre = rule.get("pre_tokenizer") or {}
        self.split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not rule.get("normalizer") and rule["model"]["type"] == "BPE"
        #: None stands for a piece that begins or ends with white space.
        self.known = Pieces(self._learn)
        self.older: dict[str, bytes | None] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.space = self.letters[32]
        self.marks = {c: self._word("", c) for c in ",.\n"} if self.split else {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of one word of letters (or one other token), after a space or not."""
        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(self.space + mapped if lead else mapped)]).tobytes()

    def _learn(self, piece: str) -> bytes | None:
        """Ids of a piece; one that does not begin with a line feed stands for itself after a space."""
        ids = self.older.get(piece, b"")
        if ids == b"":
            ids = self._ids(piece)
        self.known[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes | None:
        lead, body = ("", piece[1:]) if piece[:1] == "\n" else (" ", piece)
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        head, tail = b"" if lead else self.marks["\n"], b""
        if body[-1] in ",.":
            body, tail = body[:-1], self.marks[body[-1]]
        if not body.isalpha():
            return self._pack(self.tokenizer.encode(" " + piece if lead else piece, add_special_tokens=False).ids)
        # A word before a mark is remembered by itself as well.
        ids = self.known[body] if lead and tail else self._word(lead, body)
        return head + ids + tail

    def encode(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        known, tail = self.known, None
        if self.split and first and not first[-1].isspace() and not any(x in text for x in self.added):
            if len(known) > CACHE_WORDS:
                self.older, known = known, Pieces(self._learn)
                self.known = known
            try:
                tail = b"".join(map(known.__getitem__, rest))
            except TypeError:
                pass
        if tail is None:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self._pack(self.tokenizer.encode(first, add_special_tokens=False).ids) + tail


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- shard files -------------------------------------------------------------------------------


def pack_shard(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """doc_ids ascending, nulls first; ends: 0 and the end of each document, in ids."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    low = int(known[0]) if len(known) else 0
    rise = known.astype(np.uint64) - np.uint64(low % (1 << 64))
    parts = [elias.encode(ends.astype(np.uint64)), elias.encode(rise)]
    head = json.dumps({"documents": len(doc_ids), "nulls": nulls, "low": low, "width": width, "parts": [len(x) for x in parts], "ids": len(ids) // width}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts) + ids


class Shard:
    """A shard file, mapped; documents are found by select on the boundary sequence."""

    def __init__(self, uri: str):
        data = C.mapped(uri)
        if bytes(data[:4]) != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        n = int.from_bytes(bytes(data[4:8]), "little")
        self.head = json.loads(bytes(data[8 : 8 + n]))
        a = 8 + n
        b = a + self.head["parts"][0]
        c = b + self.head["parts"][1]
        self.ends, self.rise = elias.EliasFano(data[a:b]), elias.EliasFano(data[b:c])
        self.ids = np.frombuffer(np.ascontiguousarray(data[c:]), "<u2" if self.head["width"] == 2 else "<u4")

    def __len__(self) -> int:
        return self.head["documents"]

    def doc_ids(self) -> list[int | None]:
        known = (self.rise.decode() + np.uint64(self.head["low"] % (1 << 64))).view(np.int64)
        return [None] * self.head["nulls"] + known.tolist()

    def document(self, i: int) -> np.ndarray:
        a, b = self.ends.select([i, i + 1]).astype(np.int64)
        return self.ids[a:b]


def write(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Write shards below ``out`` (default: a fresh folder in the shared one).

    Returns the folder and the manifest (shard, part, uri, documents, tokens, start), which is also
    written there; ``start`` counts the ids of all shards before."""
    spark = docs.sparkSession
    out = out or C.fresh_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.settle()
        enc, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end, width = array(enc.code, [end_id]).tobytes(), array(enc.code).itemsize
        held_ids: list = []
        body: list[bytes] = []
        size = 0
        ends = [0]

        def flush() -> pa.RecordBatch:
            uri = f"{out}/shards/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            C.put(uri, pack_shard(held_ids, np.array(ends), b"".join(body), width))
            return pa.record_batch([[part], [seq], [uri], [len(held_ids)], [ends[-1]]], schema=manifest)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                body.append(ids)
                held_ids.append(doc_id)
                size += len(ids)
                ends.append(size // width)
                if ends[-1] >= shard_ids:
                    yield flush()
                    held_ids, body, size, ends, seq = [], [], 0, [0], seq + 1
        if held_ids:
            yield flush()

    manifest = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("uri", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
    kind = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("turn"))
    dealt = keyed.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    dealt.select("doc_id", "text").mapInArrow(run, kind).write.parquet(f"{out}/attempts")
    # One row a shard. Starts are sums over the shards before, of whole blocks of parts and within the block.
    rows = spark.read.schema(kind).parquet(f"{out}/attempts").withColumn("block", F.floor(F.col("part") / PART_BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    sums = sums.select(F.col("block").alias("b"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    within = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.join(sums, F.col("block") == F.col("b")).select(
        (F.col("n") + F.coalesce(F.count("*").over(within), F.lit(0))).alias("shard"), "part", "uri", "documents", "tokens",
        (F.col("t") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("start"),
    )
    told.write.parquet(f"{out}/manifest")
    return out, spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                ends = shard.ends.select(np.arange(len(shard) + 1)).astype(np.int64)
                ids = shard.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.record_batch([pa.array(shard.doc_ids(), pa.int64()), pa.array(ends[:-1] + start), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    told = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("uri", "start")
    n = max(1, told.count())
    return told.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    out, _ = write(docs, tokenizer_path)
    return read(docs.sparkSession, out)
