"""Chat formatting with Spark expressions only.

Turns are collected into structs and sorted, adjacent turns of one role are merged into one block by
array functions, and blocks are concatenated:

    <s>[INST]text</s>            user            <s>[OUT]text</s>             assistant
    <s>[SYS]text</s>             system          <s>[ROLE]name[/ROLE]text</s> any other role
    <s>[NONE]text</s>            null role       [TURN]                       between merged turns

A control string inside a text or a role name gets one backslash more after its first character than
it had (``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), so no text can hold a bare control string
and removing one backslash restores it exactly.

``loss`` marks what a model is trained on: assistant texts. A span is (piece, start, length) in code
points, where pieces are the parts of the formatted text between ``</s>`` and ``[TURN]`` marks.

Defined results: a null text is empty; a null role is a role of its own, read back as null; turns with
the same number go by role, then text; null turn numbers come first; repeated rows are separate turns;
rows with a null conv_id form one conversation; extra columns are ignored; an empty table gives none.
One conversation becomes one string, so it has to fit into one task; that is what the result is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = {"user": "<s>[INST]", "assistant": "<s>[OUT]", "system": "<s>[SYS]"}
_REST = r"(/?s>|INST\]|OUT\]|SYS\]|NONE\]|TURN\]|/?ROLE\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def _head(role: Column) -> Column:
    out = F.when(role.isNull(), "<s>[NONE]")
    for name, head in HEADS.items():
        out = out.when(role == name, head)
    return out.otherwise(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` -> ``(conv_id, formatted, loss)``, a row a conversation."""
    rows = turns.select("conv_id", F.struct("turn", "role", escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turn, last = F.col("turns"), F.size("turns") - 1

    def opens(i: Column) -> Column:
        return (i == 0) | ~F.get(turn, i)["role"].eqNullSafe(F.get(turn, i - 1)["role"])

    def closes(i: Column) -> Column:
        return (i == last) | ~F.get(turn, i)["role"].eqNullSafe(F.get(turn, i + 1)["role"])

    merged = F.transform(
        turn,
        lambda t, i: F.struct(
            t["role"].alias("role"), i.alias("piece"),
            F.when(opens(i), _head(t["role"])).otherwise("").alias("head"),
            t["text"].alias("text"),
            F.when(closes(i), "</s>").otherwise("[TURN]").alias("tail"),
        ),
    )
    out = sorted_turns.select("conv_id", merged.alias("p"))
    trained = F.filter("p", lambda x: F.coalesce(x["role"] == "assistant", F.lit(False)))
    return out.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"], x["tail"])), "").alias("formatted"),
        F.transform(trained, lambda x: F.struct(x["piece"].alias("piece"), F.length(x["head"]).alias("start"), F.length(x["text"]).alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` -> the turns and the text under the loss mask, as they were."""

    def turns(block: Column) -> Column:
        head = F.regexp_extract(block, r"(?s)^<s>\[(?:INST\]|OUT\]|SYS\]|NONE\]|ROLE\].*?\[/ROLE\])", 0)
        role = F.when(head == "<s>[NONE]", F.lit(None).cast("string"))
        for name, mark in HEADS.items():
            role = role.when(head == mark, name)
        role = role.otherwise(unescape(F.regexp_extract(head, r"(?s)^<s>\[ROLE\](.*)\[/ROLE\]$", 1)))
        texts = F.split(F.substr(block, F.length(head) + 1), r"\[TURN\]")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")
    pieces = formatted.select("conv_id", "formatted", "loss", F.flatten(F.transform(blocks, turns)).alias("turns"), F.split("formatted", r"</s>|\[TURN\]").alias("pieces"))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.get(F.col("pieces"), s["piece"]), s["start"] + 1, s["length"])))
    return pieces.select("conv_id", "formatted", "turns", F.array_join(masked, "").alias("loss_text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    back = read_back(format_conversations(turns.unionByName(hard)))
    written = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|INST\]|OUT\]|SYS\]|NONE\]|TURN\]|/?ROLE\]|/INST\])', '\1\\\2\3', 'g') AS safe,
    lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS joined
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN joined THEN 6 ELSE 4 + CASE WHEN role = 'user' THEN 9 WHEN role = 'assistant' THEN 8 WHEN role = 'system' THEN 8
    WHEN role IS NULL THEN 9 ELSE 16 + length(role) END END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
