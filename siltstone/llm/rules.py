"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once for each document: bit i of ``failed`` is set if rule i of ``RULES`` fails,
and the measurements stay beside it. A policy is a named, versioned set of rules; it is applied to the
ledger with one bitwise AND and never reads a text. Ablations (what would stay if a rule were left out)
come from one aggregation over the distinct masks, of which there are at most 2**len(RULES).

Edge cases: a null or empty text has no words and fails ``few_words``; a text of any length is measured
whole; repeated rows are measured row by row; an empty table gives an empty ledger; extra columns pass
through ``keep`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words")

#: Each rule says when it fails, as integer arithmetic over the measurements. The order fixes the bits.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 5 * m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    "few_letters": lambda m: 10 * m["n_alpha_words"] < 6 * m["n_words"],
    "repeated_lines": lambda m: (m["n_lines"] >= 4) & (10 * m["n_dup_lines"] > 5 * m["n_lines"]),
}
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length", "few_letters"),
    "v2": ("few_words", "repeated_windows", "symbols", "word_length", "few_letters", "repeated_lines"),
}
PRODUCTION = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in POLICIES[policy])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of the rows of one text buffer."""
    start, end, first = C.word_bounds(data, offsets)
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(first))
    prefix = C.prefix_codes(data)
    salt = C.mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(1))

    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead & ~C.SPACE[data], dtype=np.int64)])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    m = {"n_words": np.diff(first), "word_chars": points[offsets[1:]] - points[offsets[:-1]], "n_symbols": C.row_sums(_SYMBOL[data], offsets)}
    m["n_alpha_words"] = C.row_sums(letters[end] > letters[start], first)

    feed = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], feed + 1]))
    line_end = np.sort(np.concatenate([offsets[1:], feed]))
    solid = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[solid], line_end[solid]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    m["n_lines"] = np.bincount(line_row, minlength=n_rows)
    _, at = np.unique(C.mix(C.slice_hash(prefix, line_start, line_end) ^ salt[line_row]), return_index=True)
    m["n_dup_lines"] = m["n_lines"] - np.bincount(line_row[at], minlength=n_rows)

    windows = C.window_hash(C.slice_hash(prefix, start, end), WINDOW)
    inside = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 : WINDOW - 1 + len(windows)]) if len(windows) else np.zeros(0, np.int64)
    _, group, count = np.unique(C.mix(windows[inside] ^ salt[row[inside]]), return_inverse=True, return_counts=True)
    again = inside[count[group] > 1]
    n = len(start) + 1
    cover = np.cumsum(np.bincount(again, minlength=n)[:n] - np.bincount(again + WINDOW, minlength=n)[:n])[:-1] > 0
    m["n_repeat_words"] = C.row_sums(cover, first)
    return m


def judge(m: dict[str, np.ndarray]) -> np.ndarray:
    """The failure mask of each row."""
    out = np.zeros(len(m["n_words"]), np.int64)
    for bit, rule in enumerate(RULES.values()):
        out |= np.asarray(rule(m)).astype(np.int64) << bit
    return out


def _ledger_kind(docs: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in MEASURES], T.StructField("failed", T.LongType())])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch):
                m = measure(*C.flat(part.column(1)))
                yield pa.record_batch([part.column(0), *[pa.array(m[x].astype(np.int64)) for x in MEASURES], pa.array(judge(m))], names=["doc_id", *MEASURES, "failed"])

    return C.text_frame(docs).mapInArrow(run, _ledger_kind(docs))


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with ``kept``."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """(rule, failed, only, kept_without) of each rule of the policy: the documents that fail it, those
    that fail nothing else of the policy, and those that would stay without it."""
    mask = policy_mask(policy)
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << list(RULES).index(x)).cast("long").alias("bit")) for x in POLICIES[policy]]))
    cell = masks.select("m", "n", each.alias("r")).select("m", "n", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return cell.groupBy("rule").agg(total(hit).alias("failed"), total(F.col("m") == F.col("bit")).alias("only"), total((F.col("m") == F.col("bit")) | (F.col("m") == 0)).alias("kept_without"))


def keep(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns."""
    mask, at = policy_mask(policy), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch):
                failed = judge(measure(*C.flat(part.column(at))))
                yield part.filter(pa.array(failed & mask == 0))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0
    rows = apply_policy(ledger(docs)).withColumn("base_failed", base)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")
