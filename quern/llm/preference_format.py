"""Preference formatting: one shared prompt, two masked completions.

A pair of conversations (chosen, rejected), each a list of (role, text) turns,
is split at its longest common turn prefix.  The prefix is rendered once as the
prompt; the turns after it are rendered as the two completions.  A completion's
mask lists the spans (code points, end exclusive) that are trained on: text and
end marker of its assistant turns.  A whole conversation that equals the other
gives a prompt and two empty completions.

All of it is DataFrame expressions.  Turns of one conversation meet in one row
(that is what is rendered); no row ever holds more than one pair, so a frequent
first turn or conversation makes no hot group.

Defined cases: null roles and texts count as empty; turns are ordered by (turn,
role, text), nulls first, and equal turns stay; a conversation without turns
doesn't exist; null conversation ids are left out, since no pair can name them;
an empty table gives an empty one; markers inside a text are spelled with a
space after '<', so that a text can't end its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order, from rows (conv_id, turn, role, text)."""
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("t"),
    )
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _mask(turns: Column) -> Column:
    """'start:end' of each assistant turn's text and end marker in the rendered turns, comma-joined."""
    walked = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(_render(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    a["spans"],
                    F.array(
                        F.concat(
                            (a["at"] + len(START) + F.char_length(t["role"]) + 1).cast("string"),
                            F.lit(":"),
                            (a["at"] + F.char_length(_render(t)) - 1).cast("string"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return F.array_join(walked["spans"], ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Other columns of ``pairs`` and n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``chosen`` and ``rejected`` hold array<struct<role, text>>; a null one
    counts as a conversation without turns.
    """
    made = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    keep = [c for c in pairs.columns if c not in (*made, chosen, rejected)]
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    df = pairs.select(*keep, F.coalesce(F.col(chosen), nothing).alias("_a"), F.coalesce(F.col(rejected), nothing).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), shorter), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    df = df.withColumn("_k", F.least(shorter, F.coalesce(F.get(differ, F.lit(0)), shorter)))
    k = F.col("_k")
    rest = lambda x: F.slice(x, k + 1, F.size(x))
    df = df.select(*keep, k.cast("long").alias("n_prompt_turns"), F.slice(a, F.lit(1), k).alias("_p"), rest(a).alias("_a"), rest(b).alias("_b"))
    return df.select(
        *keep,
        "n_prompt_turns",
        F.array_join(F.transform("_p", _render), "").alias("prompt"),
        F.array_join(F.transform("_a", _render), "").alias("chosen"),
        F.array_join(F.transform("_b", _render), "").alias("rejected"),
        _mask(F.col("_a")).alias("chosen_mask"),
        _mask(F.col("_b")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: conv_id, chosen, rejected.

    Chosen is the conversation; rejected is the same up to its last assistant
    turn, which has the text of the last assistant turn of the neighbour
    (conv_id with its lowest bit flipped) and ends there.  Where either has no
    assistant turn, rejected is null.
    """
    convs = conversations(turns)
    t = F.col("turns")
    answers = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: t[i]["role"] == "assistant")
    convs = convs.withColumn("_last", F.array_max(answers))
    other = convs.select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"), F.get(t, F.col("_last"))["text"].alias("_text"))
    joined = convs.join(other, "conv_id", "left")
    swapped = F.concat(F.slice(t, F.lit(1), F.col("_last")), F.array(F.struct(F.lit("assistant").alias("role"), F.col("_text").alias("text"))))
    return joined.select("conv_id", t.alias("chosen"), F.when(F.col("_last").isNotNull() & F.col("_text").isNotNull(), swapped).alias("rejected"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its neighbour's last answer."""
    return format_pairs(neighbour_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, replace(text, '<|', '< |') AS text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
last AS (SELECT conv_id, max(i) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
answer AS (SELECT xor(conv_id, 1) AS conv_id, t.text FROM t JOIN last USING (conv_id) WHERE t.i = last.last),
rej AS (SELECT t.conv_id, t.i, t.role, t.text FROM t JOIN last USING (conv_id) JOIN answer USING (conv_id) WHERE t.i < last.last
  UNION ALL SELECT last.conv_id, last.last, 'assistant', answer.text FROM last JOIN answer USING (conv_id)),
paired AS (SELECT conv_id, i, t.role IS NOT NULL AND rej.role IS NOT NULL AND t.role = rej.role AND t.text = rej.text AS same FROM t FULL JOIN rej USING (conv_id, i)),
k AS (SELECT conv_id, coalesce(min(i) FILTER (NOT same), count(*)) AS k FROM paired GROUP BY conv_id),
r AS (SELECT 'c' AS side, conv_id, i, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM t
  UNION ALL SELECT 'r', conv_id, i, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM rej),
m AS (SELECT side, conv_id, i, role, s, sum(length(s)) OVER (PARTITION BY side, conv_id ORDER BY i) AS stop FROM r JOIN k USING (conv_id) WHERE i >= k),
p AS (SELECT conv_id, string_agg(s, '' ORDER BY i) AS prompt FROM r JOIN k USING (conv_id) WHERE side = 'c' AND i < k GROUP BY conv_id),
x AS (SELECT conv_id, side, string_agg(s, '' ORDER BY i) AS s,
  string_agg((stop - length(s) + 22)::BIGINT::VARCHAR || ':' || (stop - 1)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (role = 'assistant') AS mask FROM m GROUP BY conv_id, side)
SELECT k.conv_id, k.k AS n_prompt_turns, coalesce(p.prompt, '') AS prompt, coalesce(c.s, '') AS chosen, coalesce(r.s, '') AS rejected,
  coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM k LEFT JOIN p USING (conv_id) LEFT JOIN (SELECT * FROM x WHERE side = 'c') c USING (conv_id) LEFT JOIN (SELECT * FROM x WHERE side = 'r') r USING (conv_id)"""
