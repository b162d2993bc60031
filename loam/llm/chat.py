"""Chat formatting: turns of a conversation become one marked text with a loss mask, by Spark expressions only.

The template: ``<s>`` opens a conversation; a run of turns of one role is ``[INST]role[/INST]``, the texts joined by
``[+]``, then ``</s>``. A control string inside a role or text gets a backslash after its first character (one more, if
it has some already), so that it never reads as control and comes back exactly.

Defined results: a null role or text is empty; turns stand by turn number, null first, ties by role and text; repeated
rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives no row; other columns are
not read. A conversation is one training example and so one row: it is the only thing that is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import table

OPEN, HEAD, TEXT, JOIN, CLOSE = "<s>", "[INST]", "[/INST]", "[+]", "</s>"
_TAIL = r"(/?s>|/?INST\]|\+\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted (the whole text) and pieces: array of (piece, loss) whose pieces joined are formatted; loss marks what a model is trained on."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def pieces(x: Column, i: Column) -> Column:
        at = F.col("turns")
        first = (i == 0) | (F.get(at, i - 1)["role"] != x["role"])
        last = (i == F.size(at) - 1) | (F.get(at, i + 1)["role"] != x["role"])
        head = F.when(first, F.concat(F.when(i == 0, F.lit(OPEN)).otherwise(F.lit("")), F.lit(HEAD), escaped(x["role"]), F.lit(TEXT))).otherwise(F.lit(JOIN))
        return F.array(
            F.struct(head.alias("piece"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"]).alias("piece"), (x["role"] == loss_role).alias("loss")),
            F.struct(F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("piece"), F.lit(False).alias("loss")),
        )

    made = sorted_turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("pieces"))
    return made.select("conv_id", F.concat_ws("", F.transform("pieces", lambda p: p["piece"])).alias("formatted"), "pieces")


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted text again: array of (role, text)."""
    body = F.regexp_replace(formatted, r"^<s>", "")
    runs = F.filter(F.split(body, r"</s>"), lambda run: run != "")

    def turns(run: Column) -> Column:
        role = unescaped(F.substring_index(F.substring(run, len(HEAD) + 1, 2**31 - 1), TEXT, 1))
        texts = F.split(F.regexp_replace(run, r"(?s)^\[INST\].*?\[/INST\]", ""), r"\[\+\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = format_chats(turns).withColumn("turns", read_chats(F.col("formatted")))
    loss = F.concat_ws("", F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescaped(p["piece"])))
    return out.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|\+\])', '\1\\\2\3', 'g')"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER w AS rn, role IS DISTINCT FROM lag(role) OVER w AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({_ESC.format("text")}) + CASE WHEN opens THEN length({_ESC.format("role")}) + 13 + 4 ELSE 3 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
