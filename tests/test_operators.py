"""Operators beyond the registered queries, and what their plans do."""

import io

import pytest
from pyspark.sql import functions as F

from ashlar.functions.predicates import between, join_atom
from ashlar.operators import relational as op
from ashlar.plans import console, explain
from ashlar.plans.engine import Engine
from ashlar.sources import catalog
from ashlar.sources.storage import ConflictError, StoredTable


@pytest.fixture()
def stored(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 5 == 0 else i * 1.5) for i in range(20)], "k int, name string, v double")
    table = StoredTable.create(spark, f"file://{tmp_path}/t", df.schema, unique=("k",))
    assert table.insert(df.repartition(4)).first()["count"] == 20
    return table


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = op.scan(catalog.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_tax"], between("l_orderkey", 5, 50, high_open=True))
    assert set(explain.read_columns(df)) == {"l_orderkey", "l_tax"}
    pushed = " ".join(explain.pushed_filters(df))
    assert "GreaterThanOrEqual(l_orderkey,5)" in pushed and "LessThan(l_orderkey,50)" in pushed
    assert explain.exchanges(df) == 0 and "Scan parquet" in explain.formatted(df)


def test_join_strategies(spark, sf_dir):
    t = lambda n: catalog.read(spark, sf_dir, n)
    assert explain.joins(op.merge_join(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")])) == ["SortMergeJoin"]
    assert explain.joins(op.index_join(t("orders"), t("customer"), "o_custkey", "c_custkey")) == ["BroadcastHashJoin"]
    assert explain.joins(op.nested_loop_join(t("supplier"), t("nation"), join_atom("s_nationkey", "<", "n_nationkey"))) == ["BroadcastNestedLoopJoin"]
    assert op.small(t("customer"), limit=10)._jdf.queryExecution().analyzed().toString().find("broadcast") < 0


def test_cost_based_switch(spark):
    before = spark.conf.get("spark.sql.cbo.enabled")
    with explain.cost_based(spark):
        assert spark.conf.get("spark.sql.cbo.joinReorder.enabled") == "true"
    assert spark.conf.get("spark.sql.cbo.enabled") == before


def test_joins_are_reordered_by_cost(spark, sf_dir):
    """The small tables meet first, whatever order the statement has."""
    names = {"a_lineitem": "lineitem", "a_orders": "orders", "a_customer": "customer"}
    try:
        for saved, name in names.items():
            catalog.analyse(catalog.read(spark, sf_dir, name), saved)
        text = "SELECT c_name, l_tax FROM a_lineitem, a_orders, a_customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_custkey = 3"
        with explain.cost_based(spark):
            plan = spark.sql(text)._jdf.queryExecution().optimizedPlan().toString()
            lines = [x for x in plan.splitlines() if "Relation" in x or "Join" in x]
        depth = {n: next(x.index("Relation") for x in lines if f".{n}[" in x) for n in names}
        assert depth["a_lineitem"] < depth["a_orders"] == depth["a_customer"]
    finally:
        for saved in names:
            spark.sql(f"DROP TABLE IF EXISTS {saved}")


def test_no_sort_where_the_order_is_there(spark, sf_dir):
    """Grouping by the keys of a merge join adds neither an exchange nor a sort."""
    t = lambda n: catalog.read(spark, sf_dir, n)
    joined = op.merge_join(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")])
    grouped = op.group_by(joined, ["o_orderkey"], [("SUM", "l_quantity", "s")])
    assert explain.exchanges(grouped) == explain.exchanges(joined) == 2
    twice = op.sort(op.sort(t("orders"), "o_custkey"), "o_custkey")
    assert explain.plan(twice).count("Sort [") == 1


def test_merge_join_repeats_and_nulls(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "d"), (1, "e"), (None, "f")], "j int, y string")
    assert op.merge_join(a, b, [("k", "j")]).count() == 4


def test_key_scan_keeps_repeats_in_order(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (3,), (2,)], "k int")
    assert [r["k"] for r in op.key_scan(df, "k", 1, low_open=True).collect()] == [2, 3, 3]
    assert [r["k"] for r in op.key_scan(df, "k").collect()] == [1, 2, 3, 3]


def test_sort_puts_null_lowest(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r["k"] for r in op.sort(df, "k").collect()] == [None, 1, 2]
    assert [r["k"] for r in op.sort(df, ("k", False)).collect()] == [2, 1, None]


def test_insert_update_delete(stored, spark):
    assert stored.update({"v": F.col("v") + 1}, "k < 3").first()["count"] == 3
    assert {r["k"]: r["v"] for r in stored.read().filter("k < 3").collect()} == {0: None, 1: 2.5, 2: 4.0}
    assert stored.delete("v > 20").first()["count"] == 5
    assert stored.read().count() == 15 and stored.read(1).count() == 20
    assert stored.delete("k > 100").first()["count"] == 0
    rids = stored.read_with_rid().filter("k = 1").select("rid")
    assert stored.delete_rows(rids.union(rids)).first()["count"] == 1
    assert stored.delete().first()["count"] == 14 and stored.read().count() == 0
    assert stored.read_with_rid().count() == 0


def test_delete_leaves_other_files_alone(stored):
    before = set(stored._read_version()[1]["files"])
    stored.delete("k = 7")
    after = set(stored._read_version()[1]["files"])
    assert len(before & after) == 3


def test_uniqueness_and_conflicts(stored, spark):
    with pytest.raises(catalog.DuplicateError):
        stored.insert(spark.createDataFrame([(3, "again")], "k int, name string"))
    assert stored.read().count() == 20
    assert stored.insert(spark.createDataFrame([("x", None)], "NAME string, k int")).first()["count"] == 1
    number, content = stored._read_version()
    with pytest.raises(ConflictError):
        stored._write_version(number, content)
    with pytest.raises(LookupError):
        stored.insert(spark.createDataFrame([(1,)], "other int"))


def test_engine_changes(stored, spark):
    engine = Engine(spark)
    engine.add_stored("things", stored)
    assert engine.execute('INSERT INTO things (k, name) VALUES (100, "a \\"b\\""), (101, NULL)').first()[0] == 2
    assert engine.execute("SELECT t.name FROM things t WHERE t.k = 100").first()[0] == 'a "b"'
    assert engine.execute("UPDATE things SET v = k * 2 WHERE k >= 100").first()[0] == 2
    assert engine.execute("SELECT SUM(v) AS s FROM things WHERE k >= 100").first()[0] == 402.0
    assert engine.execute("DELETE FROM things t WHERE t.k >= 100 AND v < 201").first()[0] == 1
    assert engine.execute("INSERT INTO things SELECT k + 1000 AS k, name, v FROM things WHERE k < 2").first()[0] == 2


def test_catalog(spark, sf_dir):
    c = catalog.Catalog(spark).register_dir(sf_dir)
    assert c.has("partsupplier") and "n_name" in c.schema("NATION").fieldNames()
    with pytest.raises(LookupError):
        c.schema("nowhere")
    s = catalog.statistics(c.table("nation"), "n_regionkey").first()
    assert (s["cardinality"], s["n_regionkey_low"], s["n_regionkey_high"]) == (25, 0, 4)
    assert catalog.require_unique(c.table("nation"), "n_nationkey").count() == 25


def test_console(spark, sf_dir):
    engine = Engine(spark)
    engine.catalog.register_dir(sf_dir)
    out = io.StringIO()
    console.run(engine, io.StringIO("SELECT r_regionkey, r_name FROM region;\nSELECT nothing FROM region\nexit\nSELECT\n"), out)
    text = out.getvalue()
    assert "5 rows returned." in text and "no column nothing" in text and text.splitlines()[1] == "-" * (11 + 1 + 25 + 1)


def test_a_commit_between_scan_and_rewrite_is_a_conflict(stored, spark, monkeypatch):
    """Rows that another writer adds meanwhile must not slip past a change's condition."""
    real, n = StoredTable._add, stored.read().count()

    def add(self, df, content):
        files = real(self, df, content)
        monkeypatch.setattr(StoredTable, "_add", real)
        other = StoredTable(spark, stored.path)
        other.insert(stored.read().limit(1).withColumn("k", F.col("k") + 1000))
        return files

    monkeypatch.setattr(StoredTable, "_add", add)
    with pytest.raises(ConflictError):
        stored.delete("k >= 0")
    assert stored.read().count() == n + 1


def test_lookups_read_few_files(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    table = StoredTable.create(spark, f"file://{tmp_path}/t", orders.schema, keys=("o_orderkey",))
    for low in range(0, 1500, 500):
        table.insert(orders.filter(f"o_orderkey >= {low} AND o_orderkey < {low + 500}"))
    hit = table.read().filter("o_orderkey = 77")
    files = table._read_version()[1]["files"]
    assert hit.count() == orders.filter("o_orderkey = 77").count() and len(files) >= 3
    spans = spark.read.parquet(*[f"{table.path}/data/{f}" for f in files]).groupBy(F.input_file_name()).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).collect()
    assert sum(r.lo <= 77 <= r.hi for r in spans) == 1
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,77)]" in hit._jdf.queryExecution().toString()


def test_row_ids_are_unique(spark, sf_dir):
    rows = catalog.with_row_id(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    assert rows.select("rid").distinct().count() == rows.count()

