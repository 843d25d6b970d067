"""Chat formatting with Spark expressions only: sorted turn structs, merged blocks, a loss mask, and the way back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's control strings, fixed values. A block is <s>role[INST]text[/INST]</s>;
# [/INST][INST] stands between the texts of adjacent turns of one role.
OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (OPEN, CLOSE, BEGIN, END)
NEXT = END + BEGIN
LEARNED_ROLE = "assistant"


def escaped(c: Column) -> Column:
    r"""Without control strings: each backslash becomes \0, then the k-th control string \k; so a backslash always stands before its code."""
    c = F.replace(c, F.lit("\\"), F.lit("\\0"))
    return reduce(lambda x, k: F.replace(x, F.lit(CONTROLS[k]), F.lit(f"\\{k + 1}")), range(len(CONTROLS)), c)


def unescaped(c: Column) -> Column:
    c = reduce(lambda x, k: F.replace(x, F.lit(f"\\{k + 1}"), F.lit(CONTROLS[k])), range(len(CONTROLS)), c)
    return F.replace(c, F.lit("\\0"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss array<struct<start, length>> (code points, from 1, of learned texts).

    Rows are taken by turn; ties by role, then text, so repeated rows all stay. A null turn comes first, a null role or text counts
    as empty, and rows without conv_id make one conversation. Only the four named columns are read. No rows give no rows.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    fresh = lambda t, i: (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
    # A piece is what a turn adds: its lead (which also closes the block before it), then its escaped text.
    lead = lambda t, i: F.when(fresh(t, i), F.concat(F.when(i > 0, F.lit(END + CLOSE)).otherwise(""), F.lit(OPEN), escaped(t["role"]), F.lit(BEGIN))).otherwise(F.lit(NEXT))
    piece = lambda t, i: F.struct(lead(t, i).alias("lead"), escaped(t["text"]).alias("body"), (t["role"] == LEARNED_ROLE).alias("learned"))
    pieces = convs.withColumn("pieces", F.transform("turns", piece)).withColumn("n", n)
    sized = pieces.withColumn("sizes", F.transform("pieces", lambda p: F.struct(F.length(p["lead"]).alias("lead"), F.length(p["body"]).alias("body"), p["learned"].alias("learned"))))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, s: F.struct(
        (acc["at"] + s["lead"] + s["body"]).alias("at"),
        F.when(s["learned"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["lead"]).alias("start"), s["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return sized.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END + CLOSE)).alias("formatted"),
        F.aggregate("sizes", start, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>> and learned (all text under the loss mask, unescaped), from the output alone."""
    literal = lambda s: r"\Q" + s + r"\E"
    inner = F.substring(F.col("formatted"), F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN + END + CLOSE))
    blocks = F.split(inner, literal(END + CLOSE + OPEN))
    begin = len(BEGIN)
    cut = lambda b: F.struct(F.substring_index(b, BEGIN, 1).alias("role"), F.split(F.substring(b, F.locate(BEGIN, b) + begin, F.length(b)), literal(NEXT)).alias("texts"))
    turn = lambda b: F.transform(b["texts"], lambda t: F.struct(unescaped(b["role"]).alias("role"), unescaped(t).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(F.transform(blocks, cut), turn)).alias("turns"), learned.alias("learned"))


PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    back = read_chats(format_chats(turns.unionByName(probe)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(c: str) -> str:
    c = f"replace({c}, '\\', '\\0')"
    for k, control in enumerate(CONTROLS):
        c = f"replace({c}, '{control}', '\\{k + 1}')"
    return c


OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LEARNED_ROLE}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length({_escaped_sql("text")}) + CASE WHEN before IS NULL OR before <> role
    THEN length({_escaped_sql("role")}) + {len(OPEN + BEGIN + END + CLOSE)} ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
