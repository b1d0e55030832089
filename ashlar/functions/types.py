"""The closed set of column types, their text forms and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = T.StructType([T.StructField("millis", T.IntegerType()), T.StructField("offset_ms", T.IntegerType())])

TYPES: dict[str, T.DataType] = {
    "SMALL_INT": T.ShortType(),
    "INT": T.IntegerType(),
    "BIG_INT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "CHAR": T.StringType(),
    "VAR_CHAR": T.StringType(),
    "DATE": T.DateType(),
    "TIME": TIME,
    "TIMESTAMP": T.TimestampNTZType(),
    "RID": T.LongType(),
}
#: The longest CHAR or VAR_CHAR, and the most columns of a table.
MAX_LENGTH, MAX_COLUMNS = 1024, 1024

_TIME = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})(?: \(UTC ([+-])(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}))?\))?$"


def schema(columns: list[tuple], most: int = MAX_COLUMNS) -> T.StructType:
    """[(name, type[, length])] -> a Spark schema; the length of a string is kept in the field's metadata."""
    if len(columns) > most:
        raise ValueError(f"a table has {most} columns at most")
    fields = []
    for name, kind, *length in columns:
        if length and not 0 < length[0] <= MAX_LENGTH:
            raise ValueError(f"{name}: a length is 1 to {MAX_LENGTH}")
        fields.append(T.StructField(name, TYPES[kind], True, {"type": kind, **({"length": length[0]} if length else {})}))
    return T.StructType(fields)


def parse(text: Column, kind: str, length: int | None = None) -> Column:
    """A value of the type from its text form; NULL in any case is null, other unreadable texts raise.

    DATE is year-month-day, TIMESTAMP adds h:mm:ss.SSS, TIME is h:mm:ss with an
    optional offset such as (UTC +2:30).  CHAR is padded with spaces to its
    length; longer strings raise.
    """
    value = F.trim(text) if kind not in ("CHAR", "VAR_CHAR") else text
    if kind in ("CHAR", "VAR_CHAR"):
        if length is not None:
            long = F.raise_error(F.concat(F.lit("longer than "), F.lit(length), F.lit(": "), text))
            value = F.when(F.length(text) > length, long).otherwise(F.rpad(text, length, " ") if kind == "CHAR" else text)
        out = value
    elif kind == "DATE":
        out = F.to_date(value, "y-M-d")
    elif kind == "TIMESTAMP":
        out = F.to_timestamp_ntz(value, F.lit("y-M-d H:mm:ss.SSS"))
    elif kind == "TIME":
        part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(value, _TIME, i), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
        sign = F.when(F.regexp_extract(value, _TIME, 4) == "-", -1).otherwise(1)
        struct = F.struct(
            (((part(1) * 60 + part(2)) * 60 + part(3)) * 1000).cast("int").alias("millis"),
            (sign * ((part(5) * 60 + part(6)) * 60 + part(7)) * 1000).cast("int").alias("offset_ms"),
        )
        out = F.when(value.rlike(_TIME), struct).otherwise(F.raise_error(F.concat(F.lit("not a time: "), value)).cast(TIME))
    else:
        out = value.cast(TYPES[kind])
    return F.when(F.upper(F.trim(text)) == "NULL", F.lit(None)).otherwise(out)


def show(value: Column, kind: str) -> Column:
    """The text form for output: dates and times without padding, null as NULL."""
    if kind == "DATE":
        out = F.date_format(value, "y-M-d")
    elif kind == "TIMESTAMP":
        out = F.date_format(value, "y-M-d H:mm:ss.SSS")
    elif kind == "TIME":
        s = F.floor(value["millis"] / 1000)
        o = F.floor(F.abs(value["offset_ms"]) / 60000)
        clock = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
        offset = F.format_string(" (UTC %s%d:%02d)", F.when(value["offset_ms"] < 0, "-").otherwise("+"), F.floor(o / 60), o % 60)
        out = F.concat(clock, F.when(value["offset_ms"] != 0, offset).otherwise(""))
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def instant(time: Column) -> Column:
    """The sort key of a TIME: milliseconds of the day in UTC, so that equal instants compare equal."""
    return time["millis"] - time["offset_ms"]


def trim_chars(df: DataFrame, *columns: str) -> DataFrame:
    """Padded CHAR columns without their padding, so that they compare like plain strings."""
    return df.withColumns({c: F.rtrim(F.col(c)) for c in columns})
