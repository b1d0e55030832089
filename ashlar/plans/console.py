"""A console: a result as a table of fixed widths, and a loop that reads statements."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import TIME, show

#: The width of a column by type; strings take their length.
WIDTHS = {T.ShortType: 6, T.IntegerType: 11, T.LongType: 21, T.FloatType: 21, T.DoubleType: 31, T.DateType: 10, T.TimestampNTZType: 23, T.TimestampType: 23}
TIME_WIDTH, STRING_WIDTH, OTHER_WIDTH = 23, 25, 10


def _kind(field: T.StructField) -> str:
    if field.dataType == TIME:
        return "TIME"
    return {T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP"}.get(type(field.dataType), "")


def width(field: T.StructField) -> int:
    if field.dataType == TIME:
        return TIME_WIDTH
    if isinstance(field.dataType, T.StringType):
        return field.metadata.get("length", STRING_WIDTH)
    return WIDTHS.get(type(field.dataType), OTHER_WIDTH)


def print_result(df: DataFrame, out: TextIO = sys.stdout) -> int:
    """Header, a line, the rows (one partition at a time), their number."""
    widths = [width(f) for f in df.schema]
    line = lambda cells: "".join(f"{c:>{w}} " for c, w in zip(cells, widths)) + "\n"
    out.write(line(df.columns))
    out.write("-" * sum(w + 1 for w in widths) + "\n")
    n = 0
    for row in df.select(*[show(F.col(f"`{f.name}`"), _kind(f)) for f in df.schema]).toLocalIterator():
        out.write(line([x.strip() for x in row]))
        n += 1
    out.write(f"\n{n} rows returned.\n\n")
    return n


def run(engine, source: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """A statement a line, until the end or 'exit'; errors are shown and the loop goes on."""
    for line in source:
        text = line.strip().rstrip(";")
        if text.lower() in ("exit", "quit"):
            break
        if text:
            try:
                print_result(engine.execute(text), out)
            except Exception as e:  # a console shows whatever goes wrong
                out.write(f"\n{e}\n")
