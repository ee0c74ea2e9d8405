"""Cutting texts that are too long into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK_LINE = re.compile(r"\n[ \t\r]*(?=\n)")


def _ends_of_blank_lines(text: str) -> list[int]:
    """The places right after a blank line, rising."""
    return [m.end() + 1 for m in _BLANK_LINE.finditer(text)]


def forward_pieces(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces, each end the last place of the strongest kind in (start + least, start + limit].

    Kinds, strongest first: after a blank line, after a line feed, after a space or tab, anywhere.
    """
    import bisect

    blank = _ends_of_blank_lines(text)
    out, start, size = [], 0, len(text)
    while size - start > limit:
        low, high = start + least, start + limit
        k = bisect.bisect_right(blank, high)
        end = blank[k - 1] if k and blank[k - 1] > low else 0
        if not end:
            end = text.rfind("\n", low, high) + 1
        if not end:
            end = max(text.rfind(" ", low, high), text.rfind("\t", low, high)) + 1
        out.append((start, end or high))
        start = out[-1][1] - overlap
    out.append((start, size))
    return out


def bisected_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: cut at the strongest boundary near the midpoint, go on with halves that are
    longer than limit - overlap, then lengthen each piece to the left by overlap.

    Near is within a quarter of the part on either side of its midpoint; of equally strong places the
    nearest to the midpoint is taken, of two as near the left one. No piece is longer than limit.
    """
    import bisect

    blank = _ends_of_blank_lines(text)
    most, cuts = limit - overlap, [0]

    def nearest(found: list[int], mid: int) -> int:
        return min(found, key=lambda p: (abs(p - mid), p)) if found else 0

    def around(mark: str, low: int, mid: int, high: int) -> list[int]:
        left, right = text.rfind(mark, low, mid) + 1, text.find(mark, mid, high) + 1
        return [p for p in (left, right) if low < p < high]

    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            cuts.append(b)
            continue
        mid, quarter = (a + b) // 2, (b - a) // 4
        low, high = mid - quarter, mid + quarter
        k, j = bisect.bisect_right(blank, low), bisect.bisect_left(blank, mid)
        at = nearest([p for p in blank[max(k, j - 1) : j + 1] if low < p < high], mid)
        at = at or nearest(around("\n", low, mid, high), mid)
        at = at or nearest(around(" ", low, mid, high) + around("\t", low, mid, high), mid)
        at = at or mid
        todo += [(at, b), (a, at)]  # the left half is next, so the cuts come in order
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(cuts, cuts[1:])]


def split_oversized(
    df: DataFrame,
    id_col: str,
    text_col: str,
    limit: int = 2000,
    least: int = 1000,
    overlap: int = 200,
    method: str = "forward",
) -> DataFrame:
    """(id_col, piece_no, start_pos, end_pos) of every text longer than limit, counted in Unicode characters.

    method "forward": every piece ends at the last strongest boundary at least `least` after its start,
    as a reader would cut; "bisect": by recursive bisection. Both take whole texts, whatever their
    length, in one pass without a shuffle; then only the numbers of ids delivered twice meet. A null,
    empty or short text has no piece. Rows with one id are one item; should their texts differ, each
    text's pieces come out, a piece that they share once. Extra columns are not read.
    """
    if not 0 <= overlap < least < limit:
        raise ValueError("0 <= overlap < least < limit must hold")
    cut = (lambda t: forward_pieces(t, limit, least, overlap)) if method == "forward" else (lambda t: bisected_pieces(t, limit, overlap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, start, end = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(cut(text), 1):
                    rows.append(i)
                    number.append(k)
                    start.append(a)
                    end.append(b)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["id", "piece_no", "start_pos", "end_pos"])

    kind = df.schema[id_col].dataType.simpleString()
    long = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.length("text") > limit)
    pieces = long.mapInArrow(run, f"id {kind}, piece_no int, start_pos int, end_pos int")
    return pieces.dropDuplicates().withColumnRenamed("id", id_col)
