import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions import aggregates as agg
from ashlar.functions import predicates as p
from ashlar.functions import types as ty
from ashlar.operators import relational as op


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "kind,text,value",
    [
        ("SMALL_INT", " 12 ", 12),
        ("BIG_INT", "-9000000000", -9000000000),
        ("DOUBLE", "1.5", 1.5),
        ("DATE", "2004-3-9", dt.date(2004, 3, 9)),
        ("TIMESTAMP", "2004-3-9 7:05:09.250", dt.datetime(2004, 3, 9, 7, 5, 9, 250000)),
        ("INT", "null", None),
        ("DATE", "NULL", None),
    ],
)
def test_parse(spark, kind, text, value):
    assert one(spark, ty.parse(F.lit(text), kind)) == value


def test_time_has_an_offset(spark):
    t = one(spark, ty.parse(F.lit("9:30:00 (UTC +2:30)"), "TIME"))
    assert (t["millis"], t["offset_ms"]) == (34200000, 9000000)
    a, b = (ty.parse(F.lit(x), "TIME") for x in ("9:30:00 (UTC +2:30)", "7:00:00"))
    assert one(spark, ty.instant(a) == ty.instant(b))
    assert one(spark, ty.show(a, "TIME")) == "9:30:00 (UTC +2:30)"
    assert one(spark, ty.show(b, "TIME")) == "7:00:00"
    with pytest.raises(Exception, match="not a time"):
        one(spark, ty.parse(F.lit("half past"), "TIME"))


def test_strings_are_padded_and_bounded(spark):
    assert one(spark, ty.parse(F.lit("ab"), "CHAR", 4)) == "ab  "
    assert one(spark, ty.parse(F.lit("ab"), "VAR_CHAR", 4)) == "ab"
    with pytest.raises(Exception, match="longer"):
        one(spark, ty.parse(F.lit("abcde"), "VAR_CHAR", 4))
    df = spark.createDataFrame([("a   ",)], "c string")
    assert ty.trim_chars(df, "c").filter("c = 'a'").count() == 1


def test_show(spark):
    assert one(spark, ty.show(F.lit(dt.date(2004, 3, 9)), "DATE")) == "2004-3-9"
    assert one(spark, ty.show(F.lit(None).cast("int"), "INT")) == "NULL"


def test_schema():
    s = ty.schema([("a", "INT"), ("b", "CHAR", 5), ("c", "TIME")])
    assert s["b"].metadata["length"] == 5 and s["c"].dataType == ty.TIME
    with pytest.raises(ValueError):
        ty.schema([("a", "CHAR", 2000)])
    with pytest.raises(ValueError):
        ty.schema([("a", "INT")] * 1025)


def test_random_conjunctions(spark):
    """Seeded rows with nulls and random predicates against Python."""
    rng = random.Random(17)
    cell = {"a": lambda: rng.randint(-50, 50), "b": lambda: rng.random(), "c": lambda: "".join(rng.choices("abz", k=2)), "d": lambda: dt.date(2000, 1, 1) + dt.timedelta(rng.randint(0, 40))}
    rows = [tuple(None if rng.random() < 0.05 else f() for f in cell.values()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d date").cache()
    test = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    for _ in range(12):
        parts = [(rng.randrange(4), rng.choice(list(test))) for _ in range(4)]
        parts = [(i, o, list(cell.values())[i]()) for i, o in parts]
        got = op.scan(df, ["a", "b", "c", "d"], *[p.atom("abcd"[i], o, v) for i, o, v in parts]).collect()
        want = [r for r in rows if all(r[i] is not None and test[o](r[i], v) for i, o, v in parts)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        got = df.filter(p.disjunction(*[p.atom("abcd"[i], o, v) for i, o, v in parts])).count()
        assert got == sum(any(r[i] is not None and test[o](r[i], v) for i, o, v in parts) for r in rows)
    df.unpersist()


def test_inverse_and_mirror(spark):
    df = spark.createDataFrame([(a, b) for a in (None, 1, 2) for b in (None, 1, 2)], "a int, b int")
    for o in p.OPERATORS:
        yes, no = df.filter(p.join_atom("a", o, "b")), df.filter(p.join_atom("a", p.INVERSE[o], "b"))
        assert yes.count() + no.count() == 4 and yes.intersect(no).count() == 0
        assert sorted(yes.collect()) == sorted(df.filter(p.join_atom("b", p.MIRRORED[o], "a")).collect())


def test_aggregates_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, -7), (1, None), (1, 2), (2, None)], "g int, v int")
    kinds = [("COUNT", "v", "n"), ("SUM", "v", "s"), ("AVG", "v", "a"), ("MIN", "v", "lo"), ("MAX", "v", "hi")]
    found = {r["g"]: tuple(r)[1:] for r in op.group_by(df, ["g"], kinds).collect()}
    assert found == {1: (3, -5, -2, -7, 2), 2: (1, 0, None, None, None)}
    empty = df.filter("g > 5")
    assert [tuple(r) for r in op.group_by(empty, [], kinds).collect()] == [(0, 0, None, None, None)]
    assert op.group_by(empty, ["g"], kinds).collect() == []
    assert isinstance(op.group_by(df, [], kinds).schema["n"].dataType, T.IntegerType)
    with pytest.raises(TypeError):
        agg.typed(df.withColumn("t", F.lit("x")), "SUM", "t")
