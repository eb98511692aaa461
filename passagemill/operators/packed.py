"""Several values packed in one field (problem 3).

Method: minimum description length.  Every cell has a few candidate dialects: a
set of delimiters that occur in it, with quoting honoured or not.  A candidate's
description length is the cost of naming the dialect plus the code length of
each value it yields, ``-log2`` of the value's share among the values of all
cells (counted over all data), or, for a value that occurs nowhere else, an
escape plus a cost per character in which separators and stray quotes are dear.
Each cell is parsed with its cheapest dialect.  Cells in which every candidate
yields the same values need no code lengths and are parsed in the first pass.

Defined results: NULL, blank and empty-list cells give no rows; empty values
don't count; repeats and letter case are kept; a list of objects stands for its
``term`` or ``topic_descriptor`` values; ties between dialects go to the one
with more values, then to the first in the fixed order.  The id may repeat (rows
are then parsed one by one, all of them); extra columns are ignored.
"""

from __future__ import annotations

import ast
import json
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import strip_all

#: Separators known to the dialects. A slash separates only with blanks around it or, as a dialect of its own, without.
SEPARATORS = (",", ";", "|", "\t", "\n", "•", "，", "、", " / ", "/")
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "`": "`"}
#: Bits for a letter of an unknown value, for a separator or quote inside one, to escape to one, and to name a separator.
LETTER_BITS, MARK_BITS, ESCAPE_BITS, SEPARATOR_BITS = 4.5, 14.0, 5.0, 4.0
_MARKS = set(",;|\t\n•，、\"“”„«»")
#: Bits that each separator or quote inside a known value costs.
KNOWN_MARK_BITS = 10.0


def strip_outer(s: str) -> str:
    """Outer whitespace of any kind and invisible format characters."""
    s = s.strip()
    while s and (s[0] in "﻿​‌‍⁠\xad" or s[-1] in "﻿​‌‍⁠\xad"):
        s = s.strip("﻿​‌‍⁠\xad").strip()
    return s


def _structured(cell: str) -> list[str] | None:
    """Values of a JSON or Python list, None if the cell is no list."""
    if not (cell.startswith("[") and cell.endswith("]")):
        return None
    try:
        items = json.loads(cell)
    except (ValueError, RecursionError):
        try:
            items = ast.literal_eval(cell)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
    if not isinstance(items, (list, tuple)):
        return None
    out = []
    for x in items:
        if isinstance(x, dict):
            x = x.get("term", x.get("topic_descriptor"))
        if x is None or isinstance(x, (list, tuple, dict)):
            continue
        v = strip_outer(str(x))
        if v:
            out.append(v)
    return out


def _present(cell: str) -> list[str]:
    found = [s for s in SEPARATORS[:8] if s in cell]
    if "/" in cell:
        blank = any(cell[i - 1 : i].isspace() or cell[i + 1 : i + 2].isspace() for i, c in enumerate(cell) if c == "/")
        found += [" / "] if blank else []
        tight = any(not (cell[i - 1 : i].isspace() or cell[i + 1 : i + 2].isspace()) for i, c in enumerate(cell) if c == "/")
        found += ["/"] if tight else []
    return found


def parse(cell: str, separators: frozenset[str], quoted: bool) -> list[str]:
    """Values of ``cell`` under one dialect, without empty ones."""
    singles = {s for s in separators if len(s) == 1}
    spaced = " / " in separators
    out: list[str] = []
    n, i = len(cell), 0

    def ends(k: int) -> bool:
        """A separator, or the end, at k."""
        if k >= n or cell[k] in singles:
            return True
        return spaced and cell[k] == "/" and (cell[k - 1 : k].isspace() or cell[k + 1 : k + 2].isspace())

    while i <= n:
        start = i
        while start < n and not ends(start) and (cell[start].isspace() or cell[start] in "﻿​"):
            start += 1
        value = None
        if quoted and start < n and cell[start] in QUOTES:
            close = QUOTES[cell[start]]
            k = cell.find(close, start + 1)
            while k != -1:
                after = k + 1
                if after < n and cell[after] == close and close == cell[start]:  # a doubled quote stands for itself
                    k = cell.find(close, after + 1)
                    continue
                while after < n and not ends(after) and (cell[after].isspace() or cell[after] in "﻿​"):
                    after += 1
                if ends(after):
                    value, i = cell[start + 1 : k].replace(close * 2, close), after
                    break
                k = cell.find(close, k + 1)
        if value is None:
            k = start
            while not ends(k):
                k += 1
            value, i = cell[start:k], k
        value = strip_outer(value)
        if value:
            out.append(value)
        i += 1
    return out


def candidates(cell: str) -> list[tuple[str, list[str]]]:
    """The distinct parses of a cell, each with the name of its dialect. One entry: nothing to choose."""
    cell = strip_outer(cell)
    if not cell:
        return []
    listed = _structured(cell)
    if listed is not None:
        return [("list", listed)]
    found = _present(cell)
    sets = [frozenset(c) for k in range(len(found) + 1) for c in combinations(found, k)]  # every subset, whatever their number
    quoting = (True, False) if any(q in cell for q in QUOTES) else (True,)
    seen: dict[tuple[str, ...], str] = {}
    for quoted in quoting:
        for s in sets:
            values = tuple(parse(cell, s, quoted))
            seen.setdefault(values, ("q" if quoted else "n") + "".join(str(SEPARATORS.index(x)) for x in sorted(s, key=SEPARATORS.index)))
    return [(name, list(v)) for v, name in seen.items()]


def parse_named(cell: str, name: str) -> list[str]:
    cell = strip_outer(cell)
    if name == "list":
        return _structured(cell) or []
    return parse(cell, frozenset(SEPARATORS[int(x)] for x in name[1:]), name[0] == "q")


def marks(value: str) -> int:
    """Separators and quotes inside a value; a slash counts if it stands between blanks."""
    return sum(c in _MARKS for c in value) + value.count(" / ")


def unknown_bits(value: str) -> float:
    return ESCAPE_BITS + LETTER_BITS * len(value) + (MARK_BITS - LETTER_BITS) * marks(value)


def _batches(it):
    for b in it:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _first_pass(it):
    """Rows of cells with one parse; for the rest their candidates; and the chunk's value counts."""
    counts: dict[str, float] = {}

    def batch(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = ("kind", pa.int8()), ("id", pa.int64()), ("cell", pa.string()), ("dialect", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("weight", pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    memo: dict[str, list] = {}
    rows = []
    for rid, cell in _batches(it):
        if cell is None:
            continue
        found = memo.get(cell)
        if found is None:
            found = candidates(cell)
            if len(memo) < 20_000:
                memo[cell] = found
        if not found:
            continue
        share = 1.0 / len(found)
        for _, values in found:
            for v in values:
                key = v.lower()
                counts[key] = counts.get(key, 0.0) + share
        if len(found) == 1:
            rows += [(0, rid, None, None, p, v, None) for p, v in enumerate(found[0][1])]
        else:
            rows.append((1, rid, cell, None, None, None, None))
        if len(counts) > 200_000:
            rows += [(2, None, None, None, None, k, w) for k, w in counts.items()]
            counts.clear()
        if len(rows) >= 8192:
            yield batch(rows)
            rows = []
    rows += [(2, None, None, None, None, k, w) for k, w in counts.items()]
    yield batch(rows)


def _expand(it):
    """One row for each value of each candidate of an ambiguous cell, with its code length if unknown and its own count."""
    rows = []
    for b in it:
        for cell, key, copies in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found = candidates(cell)
            own: dict[str, float] = {}
            for _, values in found:
                for v in values:
                    own[v] = own.get(v, 0.0) + copies / len(found)
            for name, values in found:
                base = SEPARATOR_BITS * (len(name) - 1) + (name[0] == "q")
                rows += [(key, name, len(values), base, v, unknown_bits(v), own[v], marks(v)) for v in values] or [(key, name, 0, base, "", 0.0, 0.0, 0)]
            if len(rows) >= 8192:
                yield _expanded(rows)
                rows = []
    yield _expanded(rows)


def _expanded(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    types = pa.binary(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["cell_key", "dialect", "n", "base", "value", "unknown", "own", "marks"])


def _finish(it):
    for b in it:
        ids, pos, val = [], [], []
        for rid, cell, name in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for p, v in enumerate(parse_named(cell, name)):
                ids.append(rid), pos.append(p), val.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(val, pa.string())], names=["id", "pos", "value"])


def unpack(df: DataFrame, id_col: str, cell_col: str, only: DataFrame | None = None) -> DataFrame:
    """One row ``(id_col, pos, value)`` for each value of each cell of ``cell_col``.

    With ``only`` (ids in ``id_col``) code lengths still come from all cells,
    but just the cells of these ids are decided and given.
    """
    from passagemill.runtime import settle

    cells = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{cell_col}`").cast("string").alias("cell"))
    schema = "kind byte, id long, cell string, dialect string, pos int, value string, weight double"
    first = settle(cells.where("cell is not null").mapInArrow(_first_pass, schema))
    unsure = first.where("kind = 1").select("id", "cell")
    counts = first.where("kind = 2").groupBy("value").agg(F.sum("weight").alias("weight"))
    total = first.where("kind = 2").agg(F.sum("weight")).first()[0] or 1.0
    folded = unsure.withColumn("folded", F.lower(strip_all(F.col("cell"))))
    keyed = folded.withColumn("cell_key", F.unhex(F.md5("folded")))  # sixteen bytes of digest stand for a cell
    distinct = keyed.groupBy("folded").agg(F.first("cell_key").alias("cell_key"), F.count(F.lit(1)).alias("copies"))
    sure = first.where("kind = 0").select("id", "pos", "value")
    if only is not None:
        ids = only.select(F.col(f"`{id_col}`").cast("long").alias("id"))
        keyed, sure = settle(keyed.join(ids, "id", "left_semi")), sure.join(ids, "id", "left_semi")
        distinct = distinct.join(keyed.select("folded"), "folded", "left_semi")
    spread = distinct.select("folded", "cell_key", "copies").mapInArrow(_expand, "cell_key binary, dialect string, n int, base double, value string, unknown double, own double, marks int")
    # what copies of the cell itself add to a value's count says nothing about the value
    others = F.col("weight") - F.col("own")
    known = F.when(others >= 0.2, F.least(-F.log2(others / F.lit(float(total))) + F.col("marks") * KNOWN_MARK_BITS, F.col("unknown"))).otherwise(F.col("unknown"))
    cost = spread.join(counts, "value", "left").groupBy("cell_key", "dialect").agg((F.first("base") + F.sum(known)).alias("bits"), F.first("n").alias("n"))
    best = cost.groupBy("cell_key").agg(F.min_by("dialect", F.struct(F.round("bits", 6), -F.col("n"), "dialect")).alias("dialect"))
    chosen = keyed.join(best, "cell_key").select("id", "cell", "dialect").mapInArrow(_finish, "id long, pos int, value string")
    out = sure.unionByName(chosen)
    return out.select(F.col("id").alias(id_col), "pos", "value")


def packed_values(df: DataFrame, id_col: str, cell_col: str, least: int = 1) -> DataFrame:
    """:func:`unpack`, restricted to cells with at least ``least`` values."""
    rows = unpack(df, id_col, cell_col)
    if least <= 1:
        return rows
    more = rows.where(F.col("pos") == least - 1).select(id_col).distinct()
    return rows.join(more, id_col, "left_semi")
