"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written as <s>[INST]role[/INST]text</s>. In roles and texts a backslash is doubled and one goes after the first
character of each control string, so what a text says can't be taken for a mark, and ``unescaped`` gives it back.
Every assistant turn becomes an example: all turns before it as context, then the turn itself, of which only the text lies
under the loss mask [loss_start, loss_end). A conversation that ends in other turns gets one more row without a loss, so
that the output holds every turn. The last example of a conversation is one row that holds it whole.

Defined cases: null roles and texts count as empty; turns go by turn (nulls first), ties by role and text; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table gives an empty one; other columns are left out,
whatever their names. Every example holds all turns before its own, so the output of a conversation grows with the square
of its turns by the method itself; one task holds the turns of one conversation. A very long text is one value of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: The marks of the template.
BEGIN, ROLE, END_ROLE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, example, n_turns, formatted, loss_start, loss_end."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = F.transform("turns", lambda t: F.struct((t["role"] == trained_role).alias("trained"), F.length(escaped(t["text"])).alias("chars"), F.concat(F.lit(BEGIN + ROLE), escaped(t["role"]), F.lit(END_ROLE), escaped(t["text"]), F.lit(END)).alias("written")))
    last = F.size("marked")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("marked", i)["trained"] | (i == last))
    examples = turns.select("conv_id", marked.alias("marked")).select("conv_id", "marked", F.posexplode(ends).alias("example", "n"))
    target = F.element_at("marked", F.col("n"))
    formatted = F.array_join(F.transform(F.slice("marked", F.lit(1), F.col("n")), lambda t: t["written"]), "")
    end = F.length("formatted") - F.lit(len(END))
    rows = examples.select("conv_id", "example", F.col("n").alias("n_turns"), formatted.alias("formatted"), target["trained"].alias("trained"), target["chars"].alias("chars"))
    return rows.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("trained"), end - F.col("chars")).otherwise(0).alias("loss_start"), F.when(F.col("trained"), end).otherwise(0).alias("loss_end"))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Parses the examples of prefix_targets again; see the columns below."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = examples.groupBy("conv_id").agg(F.max_by("formatted", "n_turns").alias("whole"), F.array_sort(F.collect_list(F.struct("example", loss.alias("text")))).alias("losses"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    written_turns = F.filter(F.split("whole", END), lambda t: t != "")
    parts = F.transform(written_turns, lambda t: F.split(F.substring(t, F.lit(len(BEGIN + ROLE) + 1), F.length(t)), r"\[/INST\]", 2))
    turns = F.array_join(F.transform(parts, lambda p: F.concat(unescaped(p[0]), F.lit("\n"), unescaped(p[1]), F.lit("\n"))), "")
    losses = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    return per.select("conv_id", F.size(parts).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(losses).cast("long").alias("loss_chars"), F.sha2(losses, 256).alias("loss_sha256"), "formatted_chars")


def op3_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_digests(written(prefix_targets(conversations.unionByName(added)), "chat-examples"))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    20 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'))
       + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS chars
  FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM w)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
