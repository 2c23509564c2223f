"""Chat formatting from every participant's point of view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

ASSISTANT, NAMED, SYSTEM, END = "<|assistant|>\n", '<|user name="{}"|>\n', "<|system|>\n", "<|end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str | None = "system") -> DataFrame:
    """Renders each dialogue once for every participant, with that speaker as the assistant.

    The other speakers become named users; ``system`` turns keep their own header and are no
    participant. One row per dialogue, perspective and turn: the dialogue's text is its ``rendered``
    pieces in order of ``position``. ``char_start`` is the piece's place in that text (code points); ``mask``
    says whether it is trained on, and ``mask_start``/``mask_end`` bound the trained code points
    (the assistant's words and the end mark), null elsewhere. Pieces, not whole dialogues, are rows, so a
    dialogue that holds a third of all turns is still spread over many tasks.

    Turns are ordered by turn, speaker and text, nulls first; repeated rows are repeated turns.
    Null text is empty; a null role is a participant whose name renders as ``unknown``; a null conversation
    id is a conversation like any other. A dialogue of system turns alone has no perspective and
    gives no rows, as does an empty table. Other columns are ignored.
    """
    said = turns.select(turns[conv].alias("c"), turns[turn].alias("t"), turns[role].alias("s"), turns[text].alias("x"))
    who = said.select(F.col("c").alias("pc"), F.col("s").alias("p")).distinct()
    if system is not None:
        who = who.where(~F.col("p").eqNullSafe(F.lit(system)))
    rows = said.join(who, said.c.eqNullSafe(who.pc))
    own = F.col("s").eqNullSafe(F.col("p"))
    before, after = NAMED.split("{}")
    head = F.when(own, F.lit(ASSISTANT))
    if system is not None:
        head = head.when(F.col("s") == system, F.lit(SYSTEM))
    head = head.otherwise(F.concat(F.lit(before), F.coalesce("s", F.lit("unknown")), F.lit(after)))
    rows = rows.select("c", "p", "t", "s", "x", head.alias("h"), own.alias("mask"))
    rows = rows.withColumn("rendered", F.concat("h", F.coalesce("x", F.lit("")), F.lit(END))).withColumns({"n": F.char_length("rendered").cast("long"), "hn": F.char_length("h").cast("long")})
    rows = prefix_sums(rows.drop("h"), ["t", "s", "x"], {"char_start": "n"}, ["c", "p"])
    return rows.select(
        F.col("c").alias(conv), F.col("p").alias("perspective"), F.col("pos").alias("position"), F.col("t").alias(turn), F.col("s").alias("speaker"), "rendered", "char_start", "mask",
        F.when(F.col("mask"), F.col("char_start") + F.col("hn")).alias("mask_start"), F.when(F.col("mask"), F.col("char_start") + F.col("n")).alias("mask_end"),
    )


def op9_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH who AS (SELECT DISTINCT conv_id AS pc, role AS p FROM conversations WHERE role IS DISTINCT FROM 'system'),
r AS (
  SELECT conv_id, p AS perspective, turn, role AS speaker, text, role IS NOT DISTINCT FROM p AS mask,
    CASE WHEN role IS NOT DISTINCT FROM p THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user name="' || coalesce(role, 'unknown') || '"|>' END || chr(10) AS h
  FROM conversations JOIN who ON conv_id IS NOT DISTINCT FROM pc),
s AS (SELECT *, h || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(rendered)) OVER w - length(rendered), 0) AS char_start FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, rendered, CAST(char_start AS BIGINT) AS char_start, mask,
  CASE WHEN mask THEN CAST(char_start + length(h) AS BIGINT) END AS mask_start,
  CASE WHEN mask THEN CAST(char_start + length(rendered) AS BIGINT) END AS mask_end
FROM o
"""
