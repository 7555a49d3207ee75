"""Splitting oversized texts at natural boundaries, with overlap.

A recursive separator hierarchy (section, paragraph, line, sentence, word, character) cuts a text into atoms that
fit both limits; the atoms are packed greedily, and each piece after the first starts with the end of the piece
before. Texts within the limits never leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.text import LINE_END, line_count
from ledgerloom.runtime import Scratch, slices, small

# atomic: a CRLF is never taken for two line ends
_EOL = r"(?>\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ])"
_EOL_RE = re.compile(_EOL)
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
#: What stands before a boundary of each level but line and character; the boundary is where the match ends.
_BEFORE = {
    "section": re.compile(rf"{_EOL}(?=#{{1,6}}[ \t])|{_EOL}(?:[ \t]*{_EOL}){{2,}}"),
    "paragraph": re.compile(rf"{_EOL}(?:[ \t]*{_EOL})+"),
    "sentence": re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+"),
    "word": re.compile(r"\s+"),
}


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 3000
    max_lines: int = 60
    overlap_bytes: int = 300


class _Text:
    """Byte, line and boundary positions of one text; positions are in code points."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self._bytes = None
        if not text.isascii():
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self._bytes = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF).astype(np.int64) + (c > 0xFFFF))])
        ends = [m.span() for m in _EOL_RE.finditer(text)]
        self.line_starts = [0, *(b for _, b in ends if b < self.n)]
        self.text_ends = [a for a, _ in ends]
        if not ends or ends[-1][1] < self.n:
            self.text_ends.append(self.n)
        self._cuts: dict[str, list[int]] = {"line": self.line_starts[1:]}

    def size(self, a: int, b: int) -> int:
        return b - a if self._bytes is None else int(self._bytes[b] - self._bytes[a])

    def reach(self, a: int, size: int) -> int:
        """The largest b with size(a, b) <= size."""
        if self._bytes is None:
            return min(self.n, a + size)
        return int(np.searchsorted(self._bytes, self._bytes[a] + size, "right")) - 1

    def back(self, b: int, size: int) -> int:
        """The smallest a with size(a, b) <= size."""
        if self._bytes is None:
            return max(0, b - size)
        return int(np.searchsorted(self._bytes, self._bytes[b] - size, "left"))

    def line_of(self, a: int) -> int:
        return bisect_right(self.line_starts, a)

    def lines(self, a: int, b: int) -> int:
        return self.line_of(b - 1) - self.line_of(a) + 1 if b > a else 0

    def cuts(self, level: str) -> list[int]:
        if level not in self._cuts:
            self._cuts[level] = [m.end() for m in _BEFORE[level].finditer(self.text) if m.end() < self.n]
        return self._cuts[level]


def _atoms(t: _Text, a: int, b: int, level: int, lim: Limits, out: list[tuple[int, int, int]], why: int) -> None:
    """Cut [a, b) into parts within the limits; why is the level of the boundary at a."""
    if t.size(a, b) <= lim.max_bytes and t.lines(a, b) <= lim.max_lines:
        out.append((a, b, why))
        return
    name = LEVELS[level]
    if name == "sentence":
        # a single line: if only its separator is too much, the separator stands alone
        end = t.text_ends[t.line_of(a) - 1]
        if a < end < b and t.size(a, end) <= lim.max_bytes:
            out.extend([(a, end, why), (end, b, level - 1)])
            return
    room = max(4, lim.max_bytes - lim.overlap_bytes)
    if name == "character":
        while a < b:
            c = min(b, max(a + 1, t.reach(a, room)))
            if c < b and t.text[c - 1] == "\r" and t.text[c] == "\n" and c - 1 > a:
                c -= 1
            out.append((a, c, why))
            a, why = c, level
        return
    cuts = t.cuts(name)
    inner = cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]
    for x, y in zip([a, *inner], [*inner, b]):
        _atoms(t, x, y, level + 1, lim, out, why)
        why = level


def _overlap(t: _Text, start: int, cut: int, end: int, lim: Limits) -> int:
    """Where the piece whose new part is [cut, end) starts: within the end of the piece [start, cut)."""
    lo = max(start + 1, t.back(cut, min(lim.overlap_bytes, lim.max_bytes - t.size(cut, end))))
    # the first line that still fits
    first = t.line_of(end - 1) - lim.max_lines
    if first >= 0:
        lo = max(lo, t.line_starts[first])
    if lo >= cut:
        return cut
    for level in ("line", "sentence", "word"):
        cuts = t.cuts(level)
        i = bisect_left(cuts, lo)
        if i < len(cuts) and cuts[i] < cut:
            return cuts[i]
    if t.text[lo] == "\n" and t.text[lo - 1] == "\r":
        lo += 1
    return lo


def split_text(text: str, lim: Limits = Limits()) -> list[tuple[int, int, int, str]]:
    """(start, new_start, end, boundary) of each piece, in code points; [start, new_start) is the overlap.

    The parts [new_start, end) follow one another without a gap. Every piece has at most max_bytes bytes and touches
    at most max_lines lines. A line is cut only if it alone is over max_bytes. boundary is the level of the cut at
    new_start ("start" for the first piece). An empty text is one empty piece.
    """
    t = _Text(text)
    if t.size(0, t.n) <= lim.max_bytes and t.lines(0, t.n) <= lim.max_lines:
        return [(0, 0, t.n, "start")]
    atoms: list[tuple[int, int, int]] = []
    _atoms(t, 0, t.n, 0, lim, atoms, -1)
    out: list[tuple[int, int, int, str]] = []
    start = new = 0
    end, why = atoms[0][1], "start"
    for a, b, level in atoms[1:]:
        if t.size(start, b) <= lim.max_bytes and t.lines(start, b) <= lim.max_lines:
            end = b
            continue
        out.append((start, new, end, why))
        start, new, end, why = _overlap(t, start, a, b, lim), a, b, LEVELS[level]
    out.append((start, new, end, why))
    return out


_PIECES = pa.schema(
    [("id", pa.string()), ("piece_no", pa.int64()), ("text", pa.string()), ("start_char", pa.int64()), ("new_char", pa.int64()), ("end_char", pa.int64()), ("n_bytes", pa.int64()), ("n_lines", pa.int64()), ("boundary", pa.string()), ("cut_line", pa.int64())]
)
_DDL = "id string, piece_no bigint, text string, start_char bigint, new_char bigint, end_char bigint, n_bytes bigint, n_lines bigint, boundary string, cut_line bigint"


def _rows(lim: Limits, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                t = _Text(text)
                for no, (start, new, end, why) in enumerate(split_text(text, lim), 1):
                    line = t.line_of(new) if no > 1 else 1
                    inside = no > 1 and t.line_starts[line - 1] < new < t.text_ends[line - 1]
                    values = (key, no, text[start:end] if with_text else None, start, new, end, t.size(start, end), t.lines(start, end), why, line if inside else None)
                    for f, v in zip(_PIECES, values):
                        out[f.name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    return run


def _once(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per id (of differing texts the one with the least hash); only texts whose id is repeated are moved."""
    h = F.xxhash64("text")
    repeated = scratch.save(rows.groupBy("id").agg(F.count("*").alias("n"), F.min(h).alias("h2")).where("n > 1").select(F.col("id").alias("id2"), "h2"))
    same = F.col("id").eqNullSafe(F.col("id2"))
    again = rows.withColumn("h", h).join(small(repeated), same & (F.col("h") == F.col("h2")), "left_semi").dropDuplicates(["id"]).select("id", "text")
    return rows.join(small(repeated), same, "left_anti").unionByName(again)


def split_oversized(df: DataFrame, id_col: str, text_col: str, lim: Limits = Limits(), *, keep_small: bool = True, with_text: bool = True, dedupe: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Ordered pieces of every text: id, piece_no (1..), text, start_char, new_char, end_char, n_bytes, n_lines,
    boundary, cut_line.

    cut_line is the 1-based source line inside which the new part of a piece begins, else null: exactly the lines
    that alone are over max_bytes are cut. A text within both limits is one piece (left out with keep_small=False);
    null counts as empty. Repeated ids count once with dedupe (a null id too). Other columns are ignored; an empty table gives no
    pieces.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # as many line ends as max_lines are needed for more lines than that
    large = (F.octet_length("text") > lim.max_bytes) | (F.regexp_count("text", F.lit(LINE_END)) >= lim.max_lines)
    if not keep_small:
        rows = rows.where(large)
    if dedupe:
        rows = _once(rows, scratch or Scratch(df.sparkSession))
    big = rows.where(large).mapInArrow(_rows(lim, with_text), _DDL)
    if not keep_small:
        return big.where("n_bytes > 0")
    text = F.col("text") if with_text else F.lit(None).cast("string")
    n = F.length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    small = rows.where(~large).select(
        "id", F.lit(1).cast("bigint").alias("piece_no"), text.alias("text"), zero.alias("start_char"), zero.alias("new_char"), n.alias("end_char"), F.octet_length("text").cast("bigint").alias("n_bytes"), line_count(F.col("text")).alias("n_lines"), F.lit("start").alias("boundary"), F.lit(None).cast("bigint").alias("cut_line")
    )
    return big.unionByName(small)


def oversized_lines(df: DataFrame, id_col: str, text_col: str, lim: Limits = Limits()) -> DataFrame:
    """(id, line_no): 0 for each text that had to be split, and each line that had to be cut."""
    p = split_oversized(df, id_col, text_col, lim, keep_small=False, with_text=False, dedupe=False)
    marks = F.array_compact(F.array(F.when(F.col("piece_no") == 2, F.lit(0).cast("bigint")), F.col("cut_line")))
    return p.select("id", F.explode(marks).alias("line_no")).distinct()
