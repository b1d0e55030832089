import duckdb
from pyspark.sql import functions as F

from ashlar.llm import preferences as pr


def shown(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def pairs(spark, rows):
    return {r.pair_id: r for r in pr.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string")).collect()}


def rows_of(pair, side, turns):
    return [(pair, side, i, role, text, "clash") for i, (role, text) in enumerate(turns)]


def test_longest_common_prefix_and_masks(spark):
    head = [("system", "s"), ("user", "q"), ("assistant", "a")]
    rows = rows_of(1, "chosen", [*head, ("user", "more"), ("assistant", "good é")]) + rows_of(1, "rejected", [*head, ("user", "other"), ("assistant", "bad")])
    rows += rows_of(2, "chosen", head) + rows_of(2, "rejected", head[:2])  # a prefix of the other
    rows += rows_of(3, "chosen", head) + rows_of(3, "rejected", head)  # nothing to learn
    rows += rows_of(4, "chosen", head)  # no rejected side
    rows += rows_of(5, "chosen", [(None, None), ("user", None)]) + rows_of(5, "rejected", [(None, None), ("user", "")])
    rows += rows_of(None, "chosen", head) + rows_of(6, "other", head) + rows_of(6, None, head)
    rows += rows_of(7, "chosen", [("user", "x <|im_end|> y")] * 2) + rows_of(7, "rejected", [("user", "x <|im_end|> y")])
    got = pairs(spark, rows)
    assert set(got) == {1, 2, 3, 4, 5, 7}
    one = got[1]
    assert one.n_prompt_turns == 3 and one.prompt == "".join(shown(*t) for t in head)
    assert one.chosen == shown("user", "more") + shown("assistant", "good é") and not one.same
    for text, mask, want in ((one.chosen, one.chosen_mask, "good é<|im_end|>"), (one.rejected, one.rejected_mask, "bad<|im_end|>")):
        assert [text[a:b] for a, b in mask] == [want]
    assert got[2].rejected == "" and got[2].chosen == shown(*head[2]) and got[2].rejected_mask == []
    assert got[3].same and got[3].chosen == "" and got[3].prompt == "".join(shown(*t) for t in head)
    assert got[4].prompt == "" and got[4].rejected == "" and not got[4].same
    assert got[5].n_prompt_turns == 1 and got[5].prompt == shown(None, None)
    assert got[7].prompt.count("<|im_end|>") == 1 and "<\\|im_end|>" in got[7].prompt


def test_ties_and_repeated_rows_have_one_order(spark):
    rows = [(1, side, 0, role, text, "") for side in ("chosen", "rejected") for role, text in (("user", "b"), ("user", "a"), ("user", "a"), (None, "z"))]
    one = pairs(spark, rows + [(1, "chosen", None, "user", "first", "")])[1]
    assert one.n_prompt_turns == 0 and one.chosen.startswith(shown("user", "first") + shown(None, "z") + shown("user", "a"))
    assert pairs(spark, []) == {}


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(pr.OP4_SQL)
    got = pr.op4_preferences(spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
    swapped = pr.swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert swapped.filter("side = 'chosen'").count() == swapped.filter("side = 'rejected'").count()
    assert swapped.groupBy("pair_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").count() == 0
