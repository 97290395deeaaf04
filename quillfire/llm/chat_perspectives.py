"""Chat formatting: the dialogue once from every participant's side.

For each participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and everyone else as a named user.  ``mask`` has one
digit a character of ``rendered``: 1 where the assistant speaks (the text and
its end marker), 0 elsewhere, run-length coded as ``digit x length`` pieces.

What is said can't forge a marker: ``<|`` in a text is written ``<||``, and each
``|`` in a name is doubled, which a reader turns back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfire.llm.common import project

END = "<|end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """``conv_id, speaker, n_turns, n_own, rendered, mask``, one row for every
    conversation and participant.

    Turns are ordered by ``turn``, then role, then text (ties), a null turn
    first.  A null conversation is a conversation of its own; a null role is the
    participant ``unknown``, as is an empty one; a null text is an empty one,
    and its turn stays.  A repeated row is said twice.  Role ``system`` is the
    frame of the dialogue: it is rendered as ``<|system|>`` for everyone and
    is a participant only where nobody else speaks.  Texts are rendered whole,
    however long.  Other columns are ignored; an empty table gives an empty result.

    One shuffle, on the conversation; all rendering is by built-in functions.
    """
    t = project(turns, conv_id="conv_id", turn="turn", role="role", text="text").select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.when(F.coalesce("role", F.lit("")) == "", "unknown").otherwise(F.col("role")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    speakers = F.array_distinct(F.transform("ts", lambda x: x["role"]))
    people = F.filter(speakers, lambda x: x != "system")
    each = convs.select(
        "conv_id", "ts", F.explode(F.when(F.size(people) > 0, people).otherwise(speakers)).alias("speaker")
    )
    own = lambda x: x["role"] == F.col("speaker")
    head = lambda x: (
        F.when(own(x), F.lit("<|assistant|>\n"))
        .when(x["role"] == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.replace(x["role"], F.lit("|"), F.lit("||")), F.lit("|>\n")))
    )
    said = lambda x: F.concat(F.replace(x["text"], F.lit("<|"), F.lit("<||")), F.lit(END))
    return each.select(
        "conv_id",
        "speaker",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.size(F.filter("ts", own)).cast("bigint").alias("n_own"),
        F.array_join(F.transform("ts", lambda x: F.concat(head(x), said(x))), "").alias("rendered"),
        F.array_join(
            F.transform(
                "ts",
                lambda x: F.concat(
                    F.lit("0x"), F.length(head(x)).cast("string"),
                    F.when(own(x), F.lit(",1x")).otherwise(F.lit(",0x")), F.length(said(x)).cast("string"),
                ),
            ),
            ",",
        ).alias("mask"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role,
         coalesce(text, '') AS text FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t
), p AS (
  SELECT * FROM s WHERE speaker <> 'system'
     OR NOT EXISTS (SELECT 1 FROM s AS o WHERE o.conv_id IS NOT DISTINCT FROM s.conv_id AND o.speaker <> 'system')
), j AS (
  SELECT p.conv_id, p.speaker, t.turn, t.role, t.text, t.role = p.speaker AS own,
         CASE WHEN t.role = p.speaker THEN '<|assistant|>' || chr(10)
              WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(t.role, '|', '||') || '|>' || chr(10) END AS head,
         replace(t.text, '<|', '<||') || '<|end|>' || chr(10) AS said
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || said, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       string_agg('0x' || length(head) || CASE WHEN own THEN ',1x' ELSE ',0x' END || length(said), ','
                  ORDER BY turn NULLS FIRST, role, text) AS mask
FROM j GROUP BY conv_id, speaker
"""
