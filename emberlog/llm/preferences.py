"""Preference formatting: a shared prompt and two completions with loss masks.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (equal role and text) is
rendered once as the prompt; what follows in either is its completion. A turn renders as
`<|role|>\\n` text `<|end|>\\n`. A completion's mask lists the spans (code points, end exclusive) that carry loss:
the texts of its assistant turns with their end marks; prompt, headers and other roles carry none.

`pairs` makes pairs of whole conversations: chosen is the conversation up to its last assistant turn; rejected
branches off at one of its assistant turns, number conv_id modulo their count: that answer is stale, replaced by
the conversation's first assistant text or, where that is the same text, by an echo of the turn before it, and the
conversation ends there. So prompts have any length, and chosen completions one turn or many.

Defined results. Null texts render as empty, null roles as `unknown`; turns are ordered by turn, nulls first,
then role and text; repeated turns are kept. Turns with a null conv_id belong to no conversation, and conversations
without an assistant turn make no pair. A pair with one side missing has an empty completion there. Equal sides give
empty completions. A conversation is rendered by one task, however long. Empty tables give an empty result. Extra
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import pick, table

END = "<|end|>\n"


def pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) from (conv_id, turn, role, text); pair_id is conv_id."""
    role, text = F.coalesce(F.col("role"), F.lit("unknown")), F.coalesce(F.col("text"), F.lit(""))
    rows = pick(turns, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = F.col("role") == "assistant"
    rows = rows.withColumns({"k": F.row_number().over(order), "before": F.lag("text").over(order), "nth": F.sum(said.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "said": said})
    rows = rows.withColumns({"n": F.max("nth").over(whole), "last": F.max(F.when(F.col("said"), F.col("k"))).over(whole), "first_text": F.first(F.when(F.col("said"), F.col("text")), ignorenulls=True).over(whole)}).where("k <= last")
    rows = rows.withColumn("branch", F.max(F.when(F.col("said") & (F.col("nth") == F.pmod("conv_id", "n") + 1), F.col("k"))).over(whole))
    stale = F.when(F.col("first_text") != F.col("text"), F.col("first_text")).otherwise(F.coalesce("before", F.lit("")))
    other = F.when(F.col("k") == F.col("branch"), stale).when(F.col("k") < F.col("branch"), F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("says")), F.struct(F.lit("rejected").alias("side"), other.alias("says")))
    rows = rows.select("conv_id", "k", "role", F.explode(F.filter(sides, lambda x: x["says"].isNotNull())).alias("s"))
    return rows.select(F.col("conv_id").alias("pair_id"), "s.side", F.col("k").alias("turn"), "role", F.col("s.says").alias("text"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """start:end of each assistant text with its end mark, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, start, add, lambda a: a["out"]), ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask) from (pair_id, side, turn, role, text)."""
    role, text = F.coalesce(F.col("role"), F.lit("unknown")), F.coalesce(F.col("text"), F.lit(""))
    t = F.struct("turn", role.alias("role"), text.alias("text"))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, t))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    both = turns.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.arrays_zip("c", "r"), lambda x: x["c"] == x["r"])
    differs = F.array_position(F.transform(F.slice(same, F.lit(1), shared), lambda x: F.coalesce(x, F.lit(False))), F.lit(False)).cast("int")
    n = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(shared))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    made = n.select("pair_id", F.col("n").cast("long").alias("n_prompt"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return made.select("pair_id", "n_prompt", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(pairs(table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT *, row_number() OVER o AS k, lag(text) OVER o AS before FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), a AS (
  SELECT conv_id, k, before, text, row_number() OVER o AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
         max(k) OVER (PARTITION BY conv_id) AS last, first_value(text) OVER o AS first_text
  FROM k WHERE role = 'assistant' WINDOW o AS (PARTITION BY conv_id ORDER BY k)
), b AS (
  SELECT conv_id, k AS branch, last, CASE WHEN first_text <> text THEN first_text ELSE coalesce(before, '') END AS stale
  FROM a WHERE nth = (conv_id % n + n) % n + 1
), c AS (
  SELECT conv_id, k, role, text FROM k JOIN b USING (conv_id) WHERE k <= last
), r AS (
  SELECT conv_id, k, role, CASE WHEN k = branch THEN stale ELSE text END AS text FROM k JOIN b USING (conv_id) WHERE k <= branch
), differs AS (
  SELECT conv_id, min(k) - 1 AS n
  FROM c FULL JOIN r USING (conv_id, k)
  WHERE c.role IS NULL OR r.role IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY conv_id
), p AS (
  SELECT conv_id, coalesce(n, last) AS n FROM b LEFT JOIN differs USING (conv_id)
), s AS (
  SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r
), said AS (
  SELECT side, conv_id, k, role, text, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS turn,
         coalesce(sum(CASE WHEN k > n THEN length(role) + length(text) + 13 ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM s JOIN p USING (conv_id)
), m AS (
  SELECT *, (begins + length(role) + 5)::BIGINT::VARCHAR || ':' || (begins + length(role) + length(text) + 13)::BIGINT::VARCHAR AS mask FROM said
)
SELECT conv_id AS pair_id, any_value(n)::BIGINT AS n_prompt,
       coalesce(string_agg(CASE WHEN side = 'c' AND k <= n THEN turn END, '' ORDER BY k), '') AS prompt,
       coalesce(string_agg(CASE WHEN side = 'c' AND k > n THEN turn END, '' ORDER BY k), '') AS chosen,
       coalesce(string_agg(CASE WHEN side = 'c' AND k > n AND role = 'assistant' THEN mask END, ',' ORDER BY k), '') AS chosen_mask,
       coalesce(string_agg(CASE WHEN side = 'r' AND k > n THEN turn END, '' ORDER BY k), '') AS rejected,
       coalesce(string_agg(CASE WHEN side = 'r' AND k > n AND role = 'assistant' THEN mask END, ',' ORDER BY k), '') AS rejected_mask
FROM m GROUP BY conv_id
"""
