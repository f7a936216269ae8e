"""Problem 1: splitting oversized items at natural boundaries.

Every cut position of a text has a boundary strength. A sparse table answers "strongest
cut between i and j" in constant time, so each piece is found by one or two range-maximum
queries; ties go to the right, and the next piece steps back by the overlap.

Null or empty texts, and texts no longer than the limit, are whole items: `split_items`
passes over them and `spans` returns one span. Rows with the same key count once, the
copies' text being the same; a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._text import code_points
from quern.sources.tables import table

# Boundary strengths, and the signs that end sentences, close quotations and end clauses.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0
ENDERS = "。！？!?…؟।"
CLOSERS = "”’」』）)]】》〉\"'"
CLAUSES = "；;，,、：:"
LINE_SIGNS = "\n\r\v\f\x85  "

#: Cut positions held in one sparse table; bounds a task's memory whatever the text's length.
BLOCK = 1 << 18


def _among(points: np.ndarray, signs: str) -> np.ndarray:
    return np.isin(points, code_points(signs))


def boundary_strengths(points: np.ndarray) -> np.ndarray:
    """strength[p] of a cut before position p, for 0 <= p <= n.

    Line signs form runs: a run with two line ends (blank lines between) is a paragraph
    end, else a line end; the cut stands after the run. A full stop counts when white
    space or the end follows and it does not close a list number at a line's start.
    """
    n = len(points)
    strength = np.zeros(n + 1, dtype=np.int8)
    if n == 0:
        return strength
    line = _among(points, LINE_SIGNS)
    blank = (points == 32) | (points == 9) | (points == 0x3000) | (points == 0xA0)
    white = line | blank
    after_white = np.r_[white[1:], True]
    digit = (points >= 48) & (points <= 57)
    before_digit = np.r_[False, digit[:-1]]
    # a number that begins its line: walk back over at most three digits
    number_start = np.zeros(n, dtype=bool)
    for k in (1, 2, 3):
        if n > k:
            run = np.ones(n - k, dtype=bool)
            for j in range(1, k + 1):
                run &= digit[k - j : n - j]
            number_start[k:] |= run & (np.r_[True, white][: n - k])
    number_start[: min(4, n)] |= before_digit[: min(4, n)]
    dot = (points == 46) & after_white & ~number_start
    end = _among(points, ENDERS) | dot
    closer = _among(points, CLOSERS)
    closed = end.copy()
    for _ in range(3):  # a sentence's closing quotes and brackets belong to it
        closed |= closer & np.r_[False, closed[:-1]]
    continues = np.r_[(end | closer)[1:], False]
    strength[1:][blank] = SPACE
    strength[1:][_among(points, CLAUSES) & ~np.r_[digit[1:], False]] = CLAUSE
    strength[1:][closed & ~continues] = SENTENCE
    # white space after a sentence's end: the cut after it is as good and keeps pieces from starting with it
    carried = blank & np.r_[False, (closed & ~continues)[:-1]]
    strength[1:][carried] = SENTENCE
    if line.any():
        at = np.flatnonzero(line)
        nxt = np.r_[at[1:], n]
        # white space only between this line sign and the next
        whites = np.cumsum(np.r_[0, white])
        joined_next = (nxt < n) & (whites[nxt] - whites[at + 1] == nxt - at - 1)
        crlf = np.zeros(len(at), dtype=bool)
        crlf[:-1] = (points[at[:-1]] == 13) & (points[np.minimum(at[:-1] + 1, n - 1)] == 10)
        double = joined_next & ~crlf
        starts = np.r_[True, ~joined_next[:-1]]
        group = np.cumsum(starts) - 1
        any_double = np.zeros(group[-1] + 1, dtype=bool)
        np.logical_or.at(any_double, group, double)
        ends = np.flatnonzero(~joined_next)
        strength[at + 1] = NONE
        strength[at[ends] + 1] = np.where(any_double[group[ends]], PARAGRAPH, LINE)
    # never between a base and its combining sign, nor around a joiner
    stick = ((points >= 0x300) & (points <= 0x36F)) | (points == 0x200D) | ((points >= 0xFE00) & (points <= 0xFE0F))
    glued = np.r_[stick, False] | np.r_[False, points == 0x200D]
    strength[glued] = -1
    return strength


class SparseTable:
    """Range maximum over keys (strength, position), so that ties go to the right."""

    def __init__(self, strength: np.ndarray, offset: int, window: int):
        key = strength.astype(np.int64) * (1 << 40) + np.arange(offset, offset + len(strength), dtype=np.int64)
        self.offset, self.levels = offset, [key]
        width = 1
        while 2 * width <= min(window, len(key)):
            prev = self.levels[-1]
            self.levels.append(np.maximum(prev[:-width], prev[width:]))
            width *= 2

    def strongest(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest cut in [lo, hi]."""
        lo, hi = lo - self.offset, hi - self.offset
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        best = max(int(row[lo]), int(row[hi - (1 << k) + 1]))
        return best >> 40, best & ((1 << 40) - 1)


def spans(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of `text` as (start, end, strength of the cut at end).

    Each piece has at most `max_chars` code points, and each but the first begins
    `overlap` code points before the end of the one before it. The window of ends is the
    upper half of the permissible lengths; when that has no paragraph, line or sentence
    end, the whole window down to just past the overlap is asked. A text without any
    boundary is cut at the limit.
    """
    if max_chars < 1 or not 0 <= overlap < max_chars:
        raise ValueError("need 0 <= overlap < max_chars")
    n = len(text)
    if n <= max_chars:
        return [(0, n, PARAGRAPH)]
    strength = boundary_strengths(code_points(text))
    out, start, tab = [], 0, None
    while n - start > max_chars:
        if tab is None or start + max_chars >= tab.offset + len(tab.levels[0]):
            tab = SparseTable(strength[start : start + max(BLOCK, 2 * max_chars + 2)], start, max_chars + 1)
        lowest, limit = start + overlap + 1, start + max_chars
        upper = max(lowest, start + (max_chars + 1) // 2)
        found, at = tab.strongest(upper, limit)
        if found < SENTENCE and lowest < upper:
            lower, where = tab.strongest(lowest, upper - 1)
            if lower >= SENTENCE or lower > found == NONE:
                found, at = lower, where
        if found < NONE:
            found, at = NONE, limit
        out.append((start, at, found))
        start = at - overlap
    out.append((start, n, PARAGRAPH))
    return out


PIECE_SCHEMA = "tbl string, item_id long, piece_no int, n_pieces int, start int, stop int, strength int"


def _pieces(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tbl, ids, texts, limits, overlaps = (batch.column(k).to_pylist() for k in range(5))
            rows: list[list] = [[] for _ in range(8)]
            for name, key, text, limit, overlap in zip(tbl, ids, texts, limits, overlaps):
                found = spans(text, limit, overlap)
                for no, (a, b, s) in enumerate(found):
                    for column, value in zip(rows, (name, key, no, len(found), a, b, s, text[a:b] if with_text else None)):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds)]
            names = ["tbl", "item_id", "piece_no", "n_pieces", "start", "stop", "strength", "piece"]
            keep = 8 if with_text else 7
            yield pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])

    return run


def split_items(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of the oversized rows of `items(tbl, item_id, text)` under `limits(tbl, max_chars, overlap_chars)`.

    Only rows longer than their limit reach Python; the length test runs in the JVM. A
    table without a limit, a null text and a limit that is null yield nothing. Several
    limits for one table: the smallest limit with its smallest overlap holds. Copies of a
    key yield their pieces once per copy when `with_text` is False (callers that only
    need keys collapse them), and once per key otherwise.
    """
    bound = limits.where("max_chars is not null").groupBy("tbl").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("o"))).alias("m"))
    bound = bound.select("tbl", F.col("m.max_chars").alias("max_chars"), F.col("m.o").alias("overlap"))
    over = items.select("tbl", "item_id", "text").join(bound, "tbl").where(F.length("text") > F.col("max_chars"))
    if with_text:
        over = over.dropDuplicates(["tbl", "item_id"])
    over = over.select("tbl", "item_id", "text", "max_chars", "overlap")
    return over.mapInArrow(_pieces(with_text), PIECE_SCHEMA + (", piece string" if with_text else ""))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "prepare_file", ["text_id", "text"]).select(F.lit("prepare_file").alias("tbl"), F.col("text_id").alias("item_id"), "text")
    answers = table(spark, folder, "format_data", ["id", "answer"]).select(F.lit("format_data").alias("tbl"), F.col("id").alias("item_id"), F.col("answer").alias("text"))
    return files.unionByName(answers)


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized items, with their text."""
    return split_items(_items(spark, folder), table(spark, folder, "size_limit"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that the operator had to cut."""
    cut = split_items(_items(spark, folder), table(spark, folder, "size_limit"), with_text=False)
    return cut.where("piece_no = 0 and n_pieces > 1").select("tbl", "item_id").distinct()


def p1_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """How pieces end, by table: count, longest piece and kind of boundary."""
    cut = split_items(_items(spark, folder), table(spark, folder, "size_limit"), with_text=False)
    one = cut.dropDuplicates(["tbl", "item_id", "piece_no"])
    return one.groupBy("tbl", "strength").agg(F.count("*").alias("pieces"), F.max(F.col("stop") - F.col("start")).alias("longest"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_boundaries": p1_boundaries}
ORACLES = {
    "p1_found": """
        SELECT DISTINCT i.tbl, i.item_id FROM (
            SELECT 'prepare_file' AS tbl, text_id AS item_id, text FROM prepare_file
            UNION ALL SELECT 'format_data', id, answer FROM format_data) i
        JOIN size_limit s ON s.tbl = i.tbl WHERE length(i.text) > s.max_chars""",
}
