"""The registered queries and, for each, SQL that gives the same rows on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates as agg
from ..functions.predicates import INVERSE, MIRRORED, atom, between, conjunction, disjunction, join_atom
from ..operators import relational as op
from ..sources.catalog import duplicates, partsupplier, read, statistics, with_row_id
from ..sources.storage import StoredTable, shared_dir
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PARTSUPPLIER = """(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(l_quantity) AS INTEGER) AS ps_availqty,
  MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle.replace("{partsupplier}", PARTSUPPLIER)
        return f

    return add


class Tables:
    """The tables of a directory, read when asked for."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return partsupplier(read(self.spark, self.d, "lineitem")) if name == "partsupplier" else read(self.spark, self.d, name)


# scans and predicates


@query("SELECT l_tax, l_orderkey, l_returnflag, l_orderkey AS l_orderkey_again FROM lineitem")
def scan_project_reorder(spark, d):
    return op.scan(Tables(spark, d).lineitem, ["l_tax", "l_orderkey", "l_returnflag", ("l_orderkey", "l_orderkey_again")])


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_suppkey < 40 AND l_quantity >= 25 AND l_returnflag = 'R'")
def scan_conjunct(spark, d):
    parts = [atom("l_suppkey", "<", 40), atom("l_quantity", ">=", 25.0), atom("l_returnflag", "=", "R")]
    return op.scan(Tables(spark, d).lineitem, ["l_orderkey", "l_partkey", "l_quantity"], *parts)


_PRED = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _pred(op_: str) -> Query:
    def run(spark, d):
        o = Tables(spark, d).orders
        values = {"i": ("o_custkey", 75), "d": ("o_totalprice", 150000.0), "s": ("o_orderstatus", "F"), "t": ("o_orderdate", F.lit("1996-01-02 00:00:00").cast("timestamp_ntz"))}
        return o.agg(*[F.count(F.when(atom(c, op_, v), 1)).alias(f"n_{k}") for k, (c, v) in values.items()], F.count(F.when(atom("o_custkey", op_, 75) & atom("o_orderstatus", op_, "F"), 1)).alias("n_both"))

    return run


for _name, _op in _PRED.items():
    query(
        f"""SELECT count(*) FILTER (WHERE o_custkey {_op} 75) AS n_i, count(*) FILTER (WHERE o_totalprice {_op} 150000.0) AS n_d,
        count(*) FILTER (WHERE o_orderstatus {_op} 'F') AS n_s, count(*) FILTER (WHERE o_orderdate {_op} TIMESTAMP '1996-01-02 00:00:00') AS n_t,
        count(*) FILTER (WHERE o_custkey {_op} 75 AND o_orderstatus {_op} 'F') AS n_both FROM orders""",
        name=f"pred_{_name}",
    )(_pred(_op))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_nationkey >= 20")
def pred_or(spark, d):
    return Tables(spark, d).customer.filter(disjunction(atom("c_mktsegment", "=", "BUILDING"), atom("c_acctbal", "<", 0.0), atom("c_nationkey", ">=", 20))).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size < 20)")
def pred_invert(spark, d):
    return Tables(spark, d).part.filter(atom("p_size", INVERSE["<"], 20)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE 20 > p_size")
def pred_switch(spark, d):
    """literal op column, written with its sides switched."""
    return Tables(spark, d).part.filter(atom("p_size", MIRRORED[">"], 20)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_custkey < 75 AND o_totalprice >= 1000 AS truth FROM orders")
def pred_truth(spark, d):
    """What a predicate gives for every row."""
    return Tables(spark, d).orders.select("o_orderkey", conjunction(atom("o_custkey", "<", 75), atom("o_totalprice", ">=", 1000.0)).alias("truth"))


@query("SELECT l_partkey FROM lineitem WHERE l_partkey >= 50 AND l_partkey < 150 ORDER BY 1")
def sort_elided(spark, d):
    """A sort of rows that a key scan gives in that order: one sort in the plan."""
    return op.sort(op.key_scan(Tables(spark, d).lineitem, "l_partkey", 50, 150, high_open=True), "l_partkey")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS nation FROM customer WHERE nullif(c_nationkey, 3) <> 5")
def pred_null(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"))
    return c.filter(atom("nation", "<>", 5))


def _between(low_open: bool, high_open: bool) -> Query:
    return lambda spark, d: Tables(spark, d).orders.filter(between("o_orderkey", 100, 1100, low_open, high_open)).select("o_orderkey", "o_totalprice")


for _l in "co":
    for _h in "co":
        query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey {'>' if _l == 'o' else '>='} 100 AND o_orderkey {'<' if _h == 'o' else '<='} 1100", name=f"between_{_l}{_h}")(_between(_l == "o", _h == "o"))


@query("SELECT l_partkey FROM lineitem WHERE l_partkey >= 50 AND l_partkey < 150 ORDER BY 1")
def index_key_scan(spark, d):
    return op.key_scan(Tables(spark, d).lineitem, "l_partkey", 50, 150, high_open=True)


@query("SELECT * FROM lineitem WHERE l_orderkey = 77")
def index_eq(spark, d):
    return op.lookup(Tables(spark, d).lineitem, "l_orderkey", 77)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey > 3")
def index_range_fetch(spark, d):
    return op.range_lookup(Tables(spark, d).supplier, "s_suppkey", 3, low_open=True).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 12")
def rid_fetch(spark, d):
    """Row ids by a look-up, then the rows by their ids."""
    orders = with_row_id(Tables(spark, d).orders)
    return op.fetch(op.lookup(orders, "o_custkey", 12), orders, ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 20 ")
def rid_iterate(spark, d):
    """Rows with their ids in their file (that ids are unique is a test's matter)."""
    return with_row_id(Tables(spark, d).orders).filter("o_custkey < 20 AND rid.row >= 0").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def index_duplicates(spark, d):
    return duplicates(Tables(spark, d).lineitem, "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS cardinality, min(o_orderkey) AS o_orderkey_low, max(o_orderkey) AS o_orderkey_high, min(o_orderstatus) AS o_orderstatus_low, max(o_orderstatus) AS o_orderstatus_high FROM orders")
def table_statistics(spark, d):
    return statistics(Tables(spark, d).orders, "o_orderkey", "o_orderstatus").drop("o_orderkey_distinct", "o_orderstatus_distinct")


# changes


def _stored(spark: SparkSession, df: DataFrame) -> StoredTable:
    path = f"{shared_dir(spark)}/ashlar-tables/{uuid.uuid4().hex}"
    table = StoredTable.create(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
    table.insert(df)
    return table


def _with_count(table: StoredTable, count: DataFrame, *columns: str) -> DataFrame:
    return table.read().select(*columns).crossJoin(count.withColumnRenamed("count", "changed"))


@query("""WITH more AS (SELECT n_nationkey + 100 AS n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1)
SELECT *, (SELECT count(*) FROM more) AS changed FROM (SELECT * FROM nation UNION ALL SELECT * FROM more)""")
def insert_count(spark, d):
    nation = Tables(spark, d).nation
    table = _stored(spark, nation)
    n = table.insert(nation.filter("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return _with_count(table, n, "n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS changed FROM nation WHERE n_regionkey <> 2")
def delete_count(spark, d):
    table = _stored(spark, Tables(spark, d).nation)
    n = table.delete_rows(table.read_with_rid().filter("n_regionkey = 2").select("rid"))
    return _with_count(table, n, "n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 'moved' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 3 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = 3) AS changed FROM nation")
def update_where(spark, d):
    engine = Engine(spark)
    engine.add_stored("nation_u", _stored(spark, Tables(spark, d).nation))
    n = engine.execute('UPDATE nation_u SET n_name = "moved", n_regionkey = n_regionkey + 1 WHERE n_regionkey = 3')
    return _with_count(engine.stored["nation_u"], n, "n_nationkey", "n_name", "n_regionkey")


@query("""SELECT *, (SELECT count(*) FROM nation WHERE n_nationkey < 5) AS changed FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5)""")
def insert_select(spark, d):
    t, engine = Tables(spark, d), Engine(spark)
    engine.catalog.register("nation", t.nation)
    engine.add_stored("region_i", _stored(spark, t.region))
    n = engine.execute("INSERT INTO region_i (r_regionkey, r_name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
    return _with_count(engine.stored["region_i"], n, "r_regionkey", "r_name")


@query("SELECT *, 2::BIGINT AS changed FROM (SELECT r_regionkey, r_name FROM region UNION ALL VALUES (77, 'ATLANTIS'), (NULL, NULL))")
def insert_values(spark, d):
    engine = Engine(spark)
    engine.add_stored("region_v", _stored(spark, Tables(spark, d).region))
    n = engine.execute('INSERT INTO region_v VALUES (77, "ATLANTIS"), (NULL, NULL)')
    return _with_count(engine.stored["region_v"], n, "r_regionkey", "r_name")


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier WHERE s_acctbal < 0 AND s_nationkey <> 1) AS changed FROM supplier WHERE NOT (s_acctbal < 0 AND s_nationkey <> 1)")
def delete_where(spark, d):
    engine = Engine(spark)
    engine.add_stored("supplier_d", _stored(spark, Tables(spark, d).supplier))
    n = engine.execute("DELETE FROM supplier_d s WHERE s.s_acctbal < 0 AND s_nationkey <> 1")
    return _with_count(engine.stored["supplier_d"], n, "s_suppkey", "s_name")


# joins


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
def nlj_eq(spark, d):
    t = Tables(spark, d)
    return op.nested_loop_join(t.region, t.nation, join_atom("r_regionkey", "=", "n_regionkey")).select("r_name", "n_name")


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey")
def nlj_theta(spark, d):
    t = Tables(spark, d)
    return op.nested_loop_join(t.supplier, t.nation, join_atom("s_nationkey", "<", "n_nationkey")).select("s_suppkey", "n_nationkey")


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey = n_nationkey OR s_suppkey = n_nationkey")
def nlj_or(spark, d):
    t = Tables(spark, d)
    on = disjunction(join_atom("s_nationkey", "=", "n_nationkey"), join_atom("s_suppkey", "=", "n_nationkey"))
    return op.nested_loop_join(t.supplier, t.nation, on).select("s_suppkey", "n_nationkey")


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def cross_region_nation(spark, d):
    t = Tables(spark, d)
    return op.nested_loop_join(t.region, t.nation, None).select("r_regionkey", "n_nationkey")


@query("SELECT c_name, o_orderkey, o_totalprice FROM customer, orders WHERE c_custkey = o_custkey")
def inlj_customer_orders(spark, d):
    t = Tables(spark, d)
    return op.index_join(t.orders, t.customer, "o_custkey", "c_custkey").select("c_name", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, l_orderkey, l_extendedprice FROM part, lineitem WHERE p_partkey = l_partkey AND l_extendedprice > p_retailprice AND p_size = 15")
def inlj_filter(spark, d):
    t = Tables(spark, d)
    part = t.part.filter(atom("p_size", "=", 15))
    return op.index_join(t.lineitem, part, "l_partkey", "p_partkey", join_atom("l_extendedprice", ">", "p_retailprice")).select("p_partkey", "l_orderkey", "l_extendedprice")


@query("""SELECT r_name, n_name, s_suppkey, p_partkey, ps_availqty FROM region, nation, supplier, {partsupplier} ps, part
WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey AND s_suppkey = ps_suppkey AND ps_partkey = p_partkey AND r_name = 'ASIA' AND p_size > 25""")
def multiway_correlated(spark, d):
    t = Tables(spark, d)
    return op.correlated_joins(
        t.region.filter(atom("r_name", "=", "ASIA")),
        (t.nation, join_atom("r_regionkey", "=", "n_regionkey")),
        (t.supplier, join_atom("n_nationkey", "=", "s_nationkey")),
        (t.partsupplier, join_atom("s_suppkey", "=", "ps_suppkey")),
        (t.part, join_atom("ps_partkey", "=", "p_partkey") & atom("p_size", ">", 25)),
    ).select("r_name", "n_name", "s_suppkey", "p_partkey", "ps_availqty")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 250000")
def merge_join(spark, d):
    t = Tables(spark, d)
    return op.merge_join(t.orders.filter(atom("o_totalprice", ">", 250000.0)), t.lineitem, [("o_orderkey", "l_orderkey")]).select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_partkey, l_suppkey, ps_availqty FROM lineitem JOIN {partsupplier} ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE l_quantity < 5")
def merge_join_2key(spark, d):
    t = Tables(spark, d)
    return op.merge_join(t.lineitem.filter(atom("l_quantity", "<", 5.0)), t.partsupplier, [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")]).select("l_orderkey", "l_partkey", "l_suppkey", "ps_availqty")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS ck FROM customer) c JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS sk FROM supplier) s ON ck = sk")
def join_null_keys(spark, d):
    t = Tables(spark, d)
    c = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("ck"))
    s = t.supplier.select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("sk"))
    return op.merge_join(c, s, [("ck", "sk")]).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_extendedprice FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_acctbal > l_extendedprice")
def join_theta_residual(spark, d):
    t = Tables(spark, d)
    both = op.merge_join(t.customer, t.orders, [("c_custkey", "o_custkey")])
    return op.merge_join(both, t.lineitem, [("o_orderkey", "l_orderkey")], join_atom("c_acctbal", ">", "l_extendedprice")).select("c_custkey", "o_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_name, n_orders FROM customer, (SELECT o_custkey, count(*)::INTEGER AS n_orders FROM orders GROUP BY o_custkey) x WHERE c_custkey = o_custkey AND n_orders > 12")
def join_derived(spark, d):
    t = Tables(spark, d)
    counts = op.group_by(t.orders, ["o_custkey"], [("COUNT", "o_custkey", "n_orders")], F.col("n_orders") > 12)
    return t.customer.join(counts, join_atom("c_custkey", "=", "o_custkey")).select("c_name", "n_orders")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, d):
    n = Tables(spark, d).nation
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, join_atom("a.n_regionkey", "=", "b.n_regionkey") & join_atom("a.n_nationkey", "<", "b.n_nationkey")).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


# grouping

#: Means are rounded for the comparison; shifted by this, none lies on a half, where engines differ.
SHIFT = 0.0012345678


def _agg(kind: str) -> Query:
    def run(spark, d):
        out = op.group_by(Tables(spark, d).customer, ["c_nationkey"], [(kind, "c_acctbal", "x")])
        x = F.col("x") + SHIFT if kind == "AVG" else F.col("x")
        return out.withColumn("x", F.round(x, 2) if kind in ("SUM", "AVG") else x)

    return run


for _kind, _sql in {"count": "count(*)::INTEGER", "sum": "round(coalesce(sum(c_acctbal), 0), 2)", "avg": f"round(avg(c_acctbal) + {SHIFT}, 2)", "min": "min(c_acctbal)", "max": "max(c_acctbal)"}.items():
    query(f"SELECT c_nationkey, {_sql} AS x FROM customer GROUP BY c_nationkey", name=f"agg_{_kind}")(_agg(_kind.upper()))

_MANY = "count(*)::INTEGER AS n, round(coalesce(sum({0}), 0), 2) AS total, round(avg({0}) + 0.0012345678, 2) AS mean, min({0}) AS low, max({0}) AS high"


def _many(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    out = op.group_by(df, keys, [("COUNT", column, "n"), ("SUM", column, "total"), ("AVG", column, "mean"), ("MIN", column, "low"), ("MAX", column, "high")])
    return out.withColumns({"total": F.round("total", 2), "mean": F.round(F.col("mean") + SHIFT, 2)})


@query(f"SELECT c_nationkey, {_MANY.format('c_acctbal')} FROM customer GROUP BY c_nationkey")
def agg_multi(spark, d):
    return _many(Tables(spark, d).customer, ["c_nationkey"], "c_acctbal")


@query(f"SELECT {_MANY.format('o_totalprice')} FROM orders")
def agg_global(spark, d):
    return _many(Tables(spark, d).orders, [], "o_totalprice")


@query(f"SELECT {_MANY.format('o_totalprice')} FROM orders WHERE o_orderkey < 0")
def agg_global_empty(spark, d):
    return _many(Tables(spark, d).orders.filter("o_orderkey < 0"), [], "o_totalprice")


@query(f"SELECT o_custkey, {_MANY.format('o_totalprice')} FROM orders WHERE o_orderkey < 0 GROUP BY o_custkey")
def agg_group_empty(spark, d):
    return _many(Tables(spark, d).orders.filter("o_orderkey < 0"), ["o_custkey"], "o_totalprice")


@query("""SELECT g, count(*)::INTEGER AS n, coalesce(sum(v), 0)::BIGINT AS total, (sum(v) // nullif(count(v), 0))::BIGINT AS mean, min(v) AS low, max(v) AS high
FROM (SELECT nullif(p_brand, 'Brand#11') AS g, nullif(p_size, 7) AS v FROM part) GROUP BY g""")
def agg_nulls(spark, d):
    p = Tables(spark, d).part.select(F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("g"), F.nullif(F.col("p_size"), F.lit(7)).alias("v"))
    return op.group_by(p, ["g"], [("COUNT", "v", "n"), ("SUM", "v", "total"), ("AVG", "v", "mean"), ("MIN", "v", "low"), ("MAX", "v", "high")])


@query("SELECT p_brand, (sum(p_size) // count(p_size))::BIGINT AS mean FROM part GROUP BY p_brand")
def agg_int_avg(spark, d):
    return Tables(spark, d).part.groupBy("p_brand").agg(agg.avg_typed("p_size", integral=True).alias("mean"))


@query("SELECT c_mktsegment, min(c_name) AS low, max(c_name) AS high FROM customer GROUP BY c_mktsegment")
def agg_string_minmax(spark, d):
    return op.group_by(Tables(spark, d).customer, ["c_mktsegment"], [("MIN", "c_name", "low"), ("MAX", "c_name", "high")])


@query("SELECT count(*)::INTEGER AS n FROM lineitem WHERE l_partkey > 20 AND l_partkey <= 60")
def count_rows_in_range(spark, d):
    return op.range_lookup(Tables(spark, d).lineitem, "l_partkey", 20, 60, low_open=True).agg(agg.count_all().alias("n"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000")
def having_alias(spark, d):
    return op.group_by(Tables(spark, d).orders, ["o_custkey"], [("SUM", "o_totalprice", "total")], F.col("total") > 2000000).withColumn("total", F.round("total", 2))


# sorting: a row number over a unique key makes the order visible


def _ranked(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Places in the order of keys without one task for all rows: a range sort, then offsets by partition."""
    ordered = op.sort(df, *keys).withColumn("at", F.monotonically_increasing_id())
    # the sort's partitions are its ranges; their sizes, a row for each, give the offsets
    part = F.shiftright("at", 33)
    placed = ordered.withColumns({"part": part, "place": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("no", F.col("before") + F.col("place") + 1)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS no FROM orders")
def sort_multi_mixed(spark, d):
    return _ranked(Tables(spark, d).orders, ("o_orderstatus", True), ("o_totalprice", False), ("o_orderkey", True)).select("o_orderkey", "no")


@query("SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 4) DESC NULLS LAST, nullif(c_mktsegment, 'BUILDING') ASC NULLS FIRST, c_custkey) AS no FROM customer")
def sort_nulls(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(4)).alias("n"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("m"))
    return _ranked(c, ("n", False), ("m", True), ("c_custkey", True)).select("c_custkey", "no")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name DESC, p_partkey) AS no FROM part")
def sort_string(spark, d):
    return _ranked(Tables(spark, d).part, ("p_name", False), ("p_partkey", True)).select("p_partkey", "no")


# statements of the dialect


def _sql(text: str) -> Query:
    def run(spark, d):
        engine = Engine(spark)
        engine.catalog.register_dir(d)
        return engine.execute(text)

    return run


def statement(name: str, text: str, oracle: str) -> None:
    query(oracle, name)(_sql(text))


statement("expr_select", "SELECT l.l_orderkey, l.l_partkey, l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS charge FROM lineitem l WHERE l.l_quantity < 3",
          "SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_quantity < 3")
statement("expr_agg", "SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) AS revenue, COUNT(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*)::INTEGER AS n FROM lineitem GROUP BY l_returnflag")
statement("expr_predicate", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_extendedprice * l_discount > 5 * (2 + 3) * 100",
          "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_extendedprice * l_discount > 2500")
statement("expr_intdiv", "SELECT p_partkey, p_size / 7 AS seventh, 7 / 2 AS folded, p_size - 3 AS less FROM part",
          "SELECT p_partkey, (p_size // 7)::BIGINT AS seventh, 3::INTEGER AS folded, p_size - 3 AS less FROM part")
statement("q01", "SELECT l.l_orderkey, l.l_suppkey, l.l_extendedprice FROM lineitem l WHERE l.l_partkey = 90", "SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_partkey = 90")
statement("q02", "SELECT l.l_orderkey, l.l_partkey FROM lineitem l WHERE l.l_suppkey > 20 AND l.l_suppkey < 60", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey > 20 AND l_suppkey < 60")
statement("q03", "SELECT l.l_partkey, SUM(l.l_tax) AS taxes FROM lineitem l GROUP BY l.l_partkey", "SELECT l_partkey, sum(l_tax) AS taxes FROM lineitem GROUP BY l_partkey")
statement("q04", "SELECT p.p_name, s.s_name, ps.ps_availqty FROM part p, partsupplier ps, supplier s WHERE p.p_partkey = ps.ps_partkey AND ps.ps_suppkey = s.s_suppkey AND p.p_partkey >= 100 AND p.p_partkey <= 140",
          "SELECT p_name, s_name, ps_availqty FROM part, {partsupplier} ps, supplier WHERE p_partkey = ps_partkey AND ps_suppkey = s_suppkey AND p_partkey BETWEEN 100 AND 140")
_Q5 = "SELECT o.o_orderkey, o.o_totalprice, ps.ps_supplycost FROM orders o, lineitem l, partsupplier ps WHERE o.o_orderkey = l.l_orderkey AND l.l_partkey = ps.ps_partkey AND l.l_suppkey = ps.ps_suppkey AND o.o_orderkey >= {0} AND o.o_orderkey < {1}"
_Q5_ORACLE = "SELECT o_orderkey, o_totalprice, ps_supplycost FROM orders, lineitem, {partsupplier} ps WHERE o_orderkey = l_orderkey AND l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND o_orderkey >= {0} AND o_orderkey < {1}"
statement("q05", _Q5.format(200, 205), _Q5_ORACLE.replace("{0}", "200").replace("{1}", "205"))
statement("q06", _Q5.format(200, 215), _Q5_ORACLE.replace("{0}", "200").replace("{1}", "215"))
statement("q07", "SELECT c.c_name, o.o_orderkey, l.l_extendedprice AS price FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND o.o_totalprice > 1000.5 AND l.l_quantity > 10 ORDER BY price DESCENDING, o_orderkey",
          "SELECT c_name, o_orderkey, l_extendedprice AS price FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_totalprice > 1000.5 AND l_quantity > 10")
statement("q08", "SELECT c.c_custkey, o.o_orderkey, p.p_partkey FROM customer c, orders o, lineitem l, part p WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_partkey = p.p_partkey AND l.l_extendedprice < p.p_retailprice AND c.c_acctbal > 500",
          "SELECT c_custkey, o_orderkey, p_partkey FROM customer, orders, lineitem, part WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_extendedprice < p_retailprice AND c_acctbal > 500")
statement("q09", "SELECT n.n_name, SUM(l.l_quantity) AS quantity FROM nation n, customer c, orders o, lineitem l WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey GROUP BY n.n_name HAVING quantity > 61000",
          "SELECT n_name, sum(l_quantity) AS quantity FROM nation, customer, orders, lineitem WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY n_name HAVING sum(l_quantity) > 61000")
_Q10 = 'SELECT r.r_name, n.n_name, COUNT(s.s_suppkey) AS offers, MIN(ps.ps_supplycost) AS cheapest FROM region r, nation n, supplier s, partsupplier ps, part p WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND s.s_suppkey = ps.ps_suppkey AND ps.ps_partkey = p.p_partkey AND r.r_name = "EUROPE" GROUP BY r.r_name, n.n_name HAVING offers > 100 ORDER BY '
_Q10_ORACLE = "SELECT r_name, n_name, count(*)::INTEGER AS offers, min(ps_supplycost) AS cheapest FROM region, nation, supplier, {partsupplier} ps, part WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey AND s_suppkey = ps_suppkey AND ps_partkey = p_partkey AND r_name = 'EUROPE' GROUP BY r_name, n_name HAVING count(*) > 100"
statement("q10", _Q10 + "r_name, n_name", _Q10_ORACLE)
Q11 = _Q10 + "offers DESC, r_name, n_name ASC"
statement("q11", Q11, _Q10_ORACLE)
statement("q12", "SELECT r.r_name, p.p_brand, s.s_name, ps.ps_supplycost FROM region r, nation n, supplier s, partsupplier ps, part p, (SELECT rr.r_name AS m_region, pp.p_brand AS m_brand, MIN(x.ps_supplycost) AS lowest FROM region rr, nation nn, supplier ss, partsupplier x, part pp WHERE rr.r_regionkey = nn.n_regionkey AND nn.n_nationkey = ss.s_nationkey AND ss.s_suppkey = x.ps_suppkey AND x.ps_partkey = pp.p_partkey GROUP BY rr.r_name, pp.p_brand) m WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND s.s_suppkey = ps.ps_suppkey AND ps.ps_partkey = p.p_partkey AND m.m_region = r.r_name AND m.m_brand = p.p_brand AND m.lowest = ps.ps_supplycost",
          """WITH offers AS (SELECT r_name, p_brand, s_name, ps_supplycost FROM region, nation, supplier, {partsupplier} ps, part WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey AND s_suppkey = ps_suppkey AND ps_partkey = p_partkey)
          SELECT * FROM offers o WHERE ps_supplycost = (SELECT min(ps_supplycost) FROM offers m WHERE m.r_name = o.r_name AND m.p_brand = o.p_brand)""")  # fmt: skip


def rounded(name: str, *columns: str) -> None:
    """Sums of doubles depend on their order: compare two digits."""
    inner = QUERIES[name]
    QUERIES[name] = lambda spark, d: inner(spark, d).withColumns({c: F.round(c, 2) for c in columns})
    ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 2) AS {c}' for c in columns)}) FROM ({ORACLES[name]})"


rounded("expr_select", "charge")
rounded("expr_agg", "revenue")
rounded("q03", "taxes")
rounded("q09", "quantity")
