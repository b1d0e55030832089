"""Preference formatting [native: DataFrame functions only].

A chosen and a rejected conversation share their first turns.  The longest common
prefix of turns is found, rendered once as the prompt, and what follows becomes
two completions with masks that say which characters to train on.

Turns of both sides meet by (pair, turn number) in one aggregation, the first
differing turn number is a minimum, and a pair's turns are gathered only to be
rendered, since a rendered pair is one row.  Everything is keyed by the pair, so
the turns move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How a turn is rendered.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Marks inside a text lose their meaning by a backslash.
INNER = "<|im_"
ESCAPED = "<\\|im_"
TRAINED = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(INNER), F.lit(ESCAPED))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit("\n"), _safe(turn["text"]), F.lit(CLOSE), F.lit("\n"))


def _completion(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["shown"]), "")


def _mask(turns: Column) -> Column:
    """(start, end) of what to train on in the completion, in characters: the trained role's text and its closing mark."""
    head = lambda t: F.length(F.lit(OPEN)) + F.length(_safe(t["role"])) + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(seen: Column, t: Column) -> Column:
        start, end = seen["at"] + head(t), seen["at"] + F.length(t["shown"]) - 1
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct((seen["at"] + F.length(t["shown"])).alias("at"), F.concat(seen["spans"], F.when(t["role"] == TRAINED, span).otherwise(none)).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, same; a row for each pair.

    side is 'chosen' or 'rejected'; rows of other or null sides and of null pairs
    are left out.  A side's turns are ordered by turn number (null first), then role and
    text, so that ties and repeated rows have one order.  Turns are equal if role and
    text are, null equal to null; a null is rendered as empty.  If one side is a
    prefix of the other, its completion is empty; a pair without one of the sides
    has an empty prompt.  same says that the completions are equal, so that the pair
    teaches nothing.  Masks are arrays of (start, end) in characters of the
    completion.  Other columns are not read; an empty table gives an empty result.
    """
    rows = turns.select(
        F.col(pair_col).alias("pair_id"), F.col(side_col).alias("side"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    rows = rows.repartition("pair_id")  # all that follows is keyed by the pair
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.withColumn("no", F.row_number().over(order))
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s)
    both = rows.groupBy("pair_id", "no").agg(side("chosen"), side("rejected"))
    # a missing turn is a null struct, so it differs from one of nulls
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    gathered = both.groupBy("pair_id").agg(
        F.min(F.when(~same, F.col("no"))).alias("first_other"),
        F.max("no").alias("last"),
        F.sort_array(F.collect_list(F.struct("no", "chosen", "rejected"))).alias("turns"),
    )
    n_prompt = F.coalesce(F.col("first_other") - 1, F.col("last"))
    shown = lambda s: lambda t: F.struct(t[s]["role"].alias("role"), _render(t[s]).alias("shown"))
    after = lambda s: F.transform(F.filter("turns", lambda t: (t["no"] > F.col("n_prompt")) & t[s].isNotNull()), shown(s))
    parts = gathered.withColumn("n_prompt", n_prompt).select(
        "pair_id",
        "n_prompt",
        F.transform(F.filter("turns", lambda t: t["no"] <= F.col("n_prompt")), shown("chosen")).alias("head"),
        after("chosen").alias("c"),
        after("rejected").alias("r"),
    )
    return parts.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt_turns"),
        _completion(F.col("head")).alias("prompt"),
        _completion(F.col("c")).alias("chosen"),
        _completion(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
        (F.col("c") == F.col("r")).alias("same"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations, as (pair_id, side, turn, role, text).

    Every conversation is the chosen side of its own pair.  The rejected side has
    the same turns, but its last assistant turn holds the last assistant text of
    the neighbour: the conversation whose id differs in the lowest bit.  Without an assistant
    turn, or a neighbour with one, nothing is swapped.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    couple = F.shiftright("conv_id", 1)
    rows = rows.withColumn("couple", couple).repartition("couple")
    # one text for a conversation: that of its last assistant turn (ties: the greatest text)
    is_reply = F.col("role") == TRAINED
    of_side = lambda bit: F.max(F.when(is_reply & (F.col("conv_id").bitwiseAND(1) == bit), F.struct("turn", "text"))).over(Window.partitionBy("couple"))
    rows = rows.withColumns({"even": of_side(0), "odd": of_side(1)})
    even = F.col("conv_id").bitwiseAND(1) == 0
    own, other = F.when(even, F.col("even")).otherwise(F.col("odd")), F.when(even, F.col("odd")).otherwise(F.col("even"))
    last = is_reply & F.coalesce(F.struct("turn", "text").eqNullSafe(own), F.lit(False)) & other.isNotNull()
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(last, other["text"]).otherwise(F.col("text")).alias("text")),
    )
    each = rows.select("conv_id", "turn", "role", F.explode(sides).alias("s"))
    return each.select(F.col("conv_id").alias("pair_id"), F.col("s.side").alias("side"), "turn", "role", F.col("s.text").alias("text"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_pairs(swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"), "same"
    )


OP4_SQL = """
WITH last_reply AS (
  SELECT conv_id, arg_max(struct_pack(t := turn, x := text), struct_pack(t := turn, x := text)) AS r
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), sides AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS c_text,
         CASE WHEN c.role = 'assistant' AND c.turn IS NOT DISTINCT FROM own.r.t AND c.text IS NOT DISTINCT FROM own.r.x
                   AND other.conv_id IS NOT NULL THEN other.r.x ELSE c.text END AS r_text
  FROM conversations c
  LEFT JOIN last_reply own ON own.conv_id = c.conv_id
  LEFT JOIN last_reply other ON other.conv_id = xor(c.conv_id, 1)
), turns AS (
  SELECT conv_id, role, c_text, r_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, c_text) AS no,
         '<|im_start|>' || role || chr(10) || replace(c_text, '<|im_', '<\\|im_') || '<|im_end|>' || chr(10) AS c_shown,
         '<|im_start|>' || role || chr(10) || replace(r_text, '<|im_', '<\\|im_') || '<|im_end|>' || chr(10) AS r_shown
  FROM sides
), pairs AS (
  SELECT *, coalesce(min(CASE WHEN c_text IS DISTINCT FROM r_text THEN no END) OVER (PARTITION BY conv_id) - 1,
                     max(no) OVER (PARTITION BY conv_id)) AS n_prompt
  FROM turns
), placed AS (
  SELECT *, sum(CASE WHEN no > n_prompt THEN length(c_shown) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY no) AS c_end,
         sum(CASE WHEN no > n_prompt THEN length(r_shown) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY no) AS r_end
  FROM pairs
)
SELECT conv_id, max(n_prompt) AS n_prompt_turns,
  coalesce(string_agg(c_shown, '' ORDER BY no) FILTER (WHERE no <= n_prompt), '') AS prompt,
  coalesce(string_agg(c_shown, '' ORDER BY no) FILTER (WHERE no > n_prompt), '') AS chosen,
  coalesce(string_agg(r_shown, '' ORDER BY no) FILTER (WHERE no > n_prompt), '') AS rejected,
  coalesce(string_agg((c_end - length(c_shown) + 13 + length(role))::BIGINT || ':' || (c_end - 1)::BIGINT, ',' ORDER BY no) FILTER (WHERE no > n_prompt AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((r_end - length(r_shown) + 13 + length(role))::BIGINT || ':' || (r_end - 1)::BIGINT, ',' ORDER BY no) FILTER (WHERE no > n_prompt AND role = 'assistant'), '') AS rejected_mask,
  max(n_prompt) = max(no) AS same
FROM placed GROUP BY conv_id
"""
