"""Preference pairs: one prompt, two masked completions.

Two conversations of a pair, chosen and rejected, are compared turn by turn; the
longest common prefix of turns is rendered once as the prompt, what follows in
each as its completion. A completion's mask lists the stretches that a loss may
count: the text and end mark of assistant turns.

Turns are matched by a grouped sum over (pair, position), so a long conversation
is not one task's work before it is rendered as the one value it has to be.

Defined results: turns are numbered in the order of (turn, role, text), repeated
rows included; null role and text are equal to themselves and rendered as empty;
a pair without one side has an empty completion there and no common prefix;
equal conversations are all prompt. Rows without an id are left out. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

END = "<|end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.where("conv_id is not null").select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def resampled(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made of a table of conversations.

    Chosen is the conversation as it is. Rejected has the same turns up to its
    last assistant turn and there the last assistant turn of its partner, the
    conversation whose id differs in the last bit; without such a turn on either
    side it has nothing there.
    """
    chosen = written(numbered(turns))
    last = chosen.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("pos", "text")).alias("x"))
    last = last.select("conv_id", F.col("x.pos").alias("last"), F.col("x.text").alias("answer"))
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "answer", F.lit(True).alias("known"))
    rows = chosen.join(last.drop("answer"), "conv_id", "left").join(partner, "conv_id", "left")
    swapped = F.coalesce(F.col("pos") == F.col("last"), F.lit(False))
    rejected = rows.where("last is null or pos < last or (pos = last and known)").select(
        "conv_id", "pos", F.when(swapped, "assistant").otherwise(F.col("role")).alias("role"),
        F.when(swapped, F.col("answer")).otherwise(F.col("text")).alias("text"),
    )
    return chosen, rejected


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit(END))


def _mask(turns: str) -> Column:
    """start:end of the assistant stretches of a completion, in characters."""
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["s"])).alias("at"),
        F.when(
            x["role"].eqNullSafe(F.lit("assistant")),
            F.concat(a["out"], F.array(F.concat_ws(":", a["at"] + F.length(F.lit("<|assistant|>\n")), a["at"] + F.length(x["s"])))),
        )
        .otherwise(a["out"])
        .alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(turns, start, step, lambda a: a["out"]), ",")


def pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """conv_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both sides: conv_id, pos (distinct in a conversation), role, text.
    """
    side = lambda df, s: df.select("conv_id", "pos", "role", "text", F.lit(s).alias("side"))
    # Written first: a union of two inputs that are both dealt by conv_id fails when one is dealt anew at run time.
    both = written(side(chosen, "c")).unionByName(written(side(rejected, "r")))
    turn = F.struct("role", "text")
    same = both.groupBy("conv_id", "pos").agg(((F.count(F.lit(1)) == 2) & F.min(turn).eqNullSafe(F.max(turn))).alias("same"))
    common = same.groupBy("conv_id").agg(F.min(F.when(~F.col("same"), F.col("pos"))).alias("first"), F.count(F.lit(1)).alias("n"))
    common = common.select("conv_id", F.coalesce("first", "n").cast("long").alias("n_prompt_turns"))
    rows = both.join(common, "conv_id").select(
        "conv_id", "n_prompt_turns", "pos", "role", _rendered(F.col("role"), F.col("text")).alias("s"),
        F.when(F.col("pos") >= F.col("n_prompt_turns"), F.col("side")).when(F.col("side") == "c", "p").alias("part"),
    ).where("part is not null")
    listed = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("pos", "s", "role"))))
    out = rows.groupBy("conv_id", "n_prompt_turns").agg(*[listed(p).alias(p) for p in "pcr"])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["s"]), "")
    return out.select(
        "conv_id", "n_prompt_turns", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
        _mask("c").alias("chosen_mask"), _mask("r").alias("rejected_mask"),
    )


#: The same rows of ``resampled`` and ``pairs`` over the table ``conversations``.
SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, text
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(pos) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT t.conv_id, pos AS last, text AS answer FROM t JOIN l ON t.conv_id = l.conv_id AND pos = last),
r AS (SELECT t.conv_id, pos, role, text FROM t LEFT JOIN l USING (conv_id) WHERE last IS NULL OR pos < last
      UNION ALL SELECT a.conv_id, a.last, 'assistant', b.answer FROM a JOIN a b ON xor(b.conv_id, 1) = a.conv_id),
d AS (SELECT conv_id, pos, t.conv_id IS NOT NULL AND r.conv_id IS NOT NULL AND t.role IS NOT DISTINCT FROM r.role AND t.text IS NOT DISTINCT FROM r.text AS same
      FROM t FULL JOIN r USING (conv_id, pos)),
n AS (SELECT conv_id, coalesce(min(pos) FILTER (NOT same), count(*)) AS n_prompt_turns FROM d GROUP BY conv_id),
b AS (SELECT *, 'c' AS side FROM t UNION ALL SELECT *, 'r' FROM r),
s AS (SELECT conv_id, n_prompt_turns, pos, role, side,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s FROM b JOIN n USING (conv_id)),
m AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id, side, pos < n_prompt_turns ORDER BY pos) AS e FROM s)
SELECT conv_id, n_prompt_turns::BIGINT AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 'c' AND pos < n_prompt_turns), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 'c' AND pos >= n_prompt_turns), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 'r' AND pos >= n_prompt_turns), '') AS rejected,
  coalesce(string_agg((e - length(s) + 14)::BIGINT || ':' || e::BIGINT, ',' ORDER BY pos) FILTER (side = 'c' AND pos >= n_prompt_turns AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((e - length(s) + 14)::BIGINT || ':' || e::BIGINT, ',' ORDER BY pos) FILTER (side = 'r' AND pos >= n_prompt_turns AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY conv_id, n_prompt_turns
"""
