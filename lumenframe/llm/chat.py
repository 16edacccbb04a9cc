"""Chat formatting with Spark expressions only.

Turns are collected per conversation and sorted; adjacent turns of one role share
a header and are parted by a separator inside it, so that reading back recovers
every turn.  A loss span is recorded for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks, and the control strings escaped in texts.
OPEN, CLOSE, SAME, END = "<|", "|>", "<|same|>", "<|end|>\n"
CONTROL = r"(?=\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """Percent signs, and the first character of every control string."""
    text = F.regexp_replace(text, "%", "%25")
    text = F.regexp_replace(text, "<" + CONTROL, "%3C")
    return F.regexp_replace(text, r"\[" + CONTROL, "%5B")


def unescape(text: Column) -> Column:
    for mark, char in (("%3C", "<"), ("%5B", "["), ("%7C", "|"), ("%25", "%")):
        text = F.regexp_replace(text, mark, char)
    return text


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escape(role), r"\|", "%7C"), "<", "%3C")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans (array of 1-based start and
    length, in code points of formatted).

    Null role and null text count as empty.  Turns are ordered by turn (nulls first),
    then role, then text; repeated rows stay.  Rows with null conversation id form one
    conversation.  Other columns are ignored.  A conversation is one output string, so
    its rows meet in one task; they are bounded by what one training sample can hold.
    """
    rows = turns.select(
        F.col(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("t"),
    )
    chats = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        header = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(CLOSE))
        same = F.get(F.col("turns"), i - 1)["role"] == t["role"]
        lead = F.when(i == 0, header).when(same, F.lit(SAME)).otherwise(F.concat(F.lit(END), header))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))

    def span(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["lead"])
        size = F.char_length(p["body"])
        more = F.concat(acc["spans"], F.array(F.struct((start + 1).alias("start"), size.alias("length"))))
        return F.struct((start + size).alias("at"), F.when(p["learn"], more).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    return (
        chats.select(conv_col, F.transform("turns", piece).alias("pieces"))
        .select(
            conv_col,
            F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END)).alias("formatted"),
            F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("spans")), span, lambda acc: acc["spans"]).alias("loss_spans"),
        )
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both taken from the output."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.regexp_extract(block, r"^<\|([^|]*)\|>", 1)
        body = F.substring(block, F.char_length(role) + 5, F.char_length(block))
        texts = F.split(body, r"<\|same\|>", -1)
        return F.transform(texts, lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    learnt = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return chats.select("*", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(learnt, "").alias("loss_text"))


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
t AS (
  SELECT *, lag(role) OVER w AS before,
    length(regexp_replace(regexp_replace(replace(text, '%', '%25'), '<(\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '%3C\1', 'g'), '\[(\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '%5B\1', 'g')) AS body,
    length(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C')) + 4 AS header
  FROM clean WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(body + CASE WHEN before IS NULL THEN header WHEN before = role THEN 8 ELSE 8 + header END) + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
