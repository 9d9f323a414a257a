"""Operator 9: preference formatting, in DataFrame expressions only.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns is rendered once as the
prompt; what follows becomes two completions, each with the character ranges that count for the loss: what an
assistant says and its end mark.

Turns are put in order of turn, role and text; turns that are the same in all three count once.  A null text renders
as an empty one, a null role as ``unknown``.  Marks inside a text or a role are broken up and a role is one line, so neither
can open or close a turn.  A turn without a conversation id is a conversation of its own.
A pair without a difference has the whole conversation as its prompt and two empty completions.  A conversation
is assembled in one row, as its rendered text is; equal conversations stay apart under their own ids.

An empty table gives no rows; texts of any length are rendered whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def assemble(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: its id and ``turns``, an ordered array of (turn, role, text)."""
    alone = F.when(F.col(id_col).isNull(), F.struct("turn", "role", "text"))
    return turns.groupBy(F.col(id_col), alone.alias("alone__")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns")).drop("alone__")


def render(turn: Column) -> Column:
    """The text of one turn between its marks."""
    plain = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    role = F.translate(plain(F.coalesce(turn["role"], F.lit("unknown"))), "\n\r", "  ")
    return F.concat(F.lit(OPEN), role, F.lit("\n"), plain(F.coalesce(turn["text"], F.lit(""))), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def loss_ranges(turns: Column) -> Column:
    """``start:end`` of each assistant's words and end mark in the rendered turns, joined by commas; code points, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, turn: Column) -> Column:
        end = (state["at"] + F.length(render(turn))).cast("int")
        first = (state["at"] + len(OPEN) + len("assistant\n")).cast("string")
        add = F.concat(F.when(state["out"] != "", ",").otherwise(""), first, F.lit(":"), end.cast("string"))
        own = turn["role"].eqNullSafe(F.lit("assistant"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.when(own, add).otherwise("")).alias("out"))

    return F.aggregate(turns, start, step, lambda s: s["out"])


def common_prefix(chosen: str, rejected: str) -> Column:
    """Number of leading turns that both have alike."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    same = lambda i: F.get(chosen, i)["role"].eqNullSafe(F.get(rejected, i)["role"]) & F.get(chosen, i)["text"].eqNullSafe(F.get(rejected, i)["text"])
    differ = F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: ~same(i))
    first = F.array_position(differ, F.lit(True))
    return F.when(shorter < 1, F.lit(0)).when(first > 0, first - 1).otherwise(shorter).cast("int")


def format_preferences(pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Prompt, completions and loss ranges of pairs with array columns ``chosen`` and ``rejected`` of turns."""
    p = pairs.select(F.col(id_col), F.coalesce("chosen", F.array().cast(pairs.schema["chosen"].dataType)).alias("c"), F.coalesce("rejected", F.array().cast(pairs.schema["rejected"].dataType)).alias("r"))
    p = p.withColumn("k", common_prefix("c", "r"))
    rest = lambda name: F.slice(F.col(name), F.col("k") + 1, F.greatest(F.size(name) - F.col("k"), F.lit(0)))
    return p.select(
        id_col,
        F.size("c").cast("long").alias("n_turns"),
        F.col("k").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        loss_ranges(rest("c")).alias("chosen_loss"),
        loss_ranges(rest("r")).alias("rejected_loss"),
    )


def weaken(turns: str) -> Column:
    """A rejected branch of a conversation: its last assistant turn says again what the first one said, or nothing if there is one only."""
    spoke = F.transform(turns, lambda t: t["role"].eqNullSafe(F.lit("assistant")))
    last = F.size(turns) - F.array_position(F.reverse(spoke), F.lit(True))
    first = F.array_position(spoke, F.lit(True)) - 1
    text = F.when(first < last, F.get(turns, first)["text"]).otherwise(F.lit(""))
    swapped = F.transform(turns, lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == last, text).otherwise(t["text"]).alias("text")))
    return F.when(F.array_contains(spoke, True), swapped).otherwise(F.col(turns))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its weakened branch, formatted as a preference pair."""
    whole = assemble(table(spark, sf_dir, "conversations"))
    return format_preferences(whole.select("conv_id", F.col("turns").alias("chosen"), weaken("turns").alias("rejected")))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n FROM t),
a AS (SELECT conv_id, max(i) AS last_i, min(i) AS first_i, arg_min(text, i) AS first_text FROM r WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT r.*, CASE WHEN i = last_i THEN CASE WHEN first_i < last_i THEN first_text ELSE '' END ELSE text END AS worse
      FROM r LEFT JOIN a USING (conv_id)),
q AS (SELECT *, coalesce(min(CASE WHEN text IS DISTINCT FROM worse THEN i END) OVER (PARTITION BY conv_id) - 1, n) AS k FROM p),
d AS (SELECT conv_id, i, n, k, role,
        '{OPEN}' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS c,
        '{OPEN}' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(worse, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS w FROM q),
e AS (SELECT *, sum(CASE WHEN i > k THEN length(c) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS ce,
        sum(CASE WHEN i > k THEN length(w) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS we FROM d)
SELECT conv_id, CAST(any_value(n) AS BIGINT) AS n_turns, CAST(any_value(k) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i <= k), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i > k), '') AS chosen,
  coalesce(string_agg(w, '' ORDER BY i) FILTER (WHERE i > k), '') AS rejected,
  coalesce(string_agg(CAST(ce - length(c) + {len(OPEN) + 10} AS BIGINT) || ':' || CAST(ce AS BIGINT), ',' ORDER BY i) FILTER (WHERE i > k AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(CAST(we - length(w) + {len(OPEN) + 10} AS BIGINT) || ':' || CAST(we AS BIGINT), ',' ORDER BY i) FILTER (WHERE i > k AND role = 'assistant'), '') AS rejected_loss
FROM e GROUP BY conv_id
"""
