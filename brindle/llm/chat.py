"""Operator 3: chat formatting, Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role share a block; the blocks are concatenated:

    <|im_start|>role\\ntext[<|im_sep|>text ...]<|im_end|>\\n

Control strings inside texts and roles are escaped with entities, so the output can be read back exactly.  Beside the string, the
output holds its segments with a loss flag: the loss mask in run-length form, with assistant texts flagged and nothing else.

Defined results: a null text or role counts as empty; a null turn sorts first; turns with equal numbers sort by role, then text, and
repeated rows are turns each; null conversation ids form one conversation; an empty table gives an empty table.  One output row is
one conversation, so a conversation must fit into a task, as it must into a row; all expressions are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings inside texts and what stands for them; `&` goes first and comes back last.
ESCAPES = (
    ("&", "&amp;"), ("<|", "&lt;|"), ("</s>", "&lt;/s>"), ("<s>", "&lt;s>"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]"),
    ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>"),
)


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for safe, raw in (("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted string, segments array<struct<text, loss>>), a row for each conversation."""
    empty = F.lit("")
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv).alias("_conv")).agg(F.sort_array(F.collect_list(row)).alias("_turns"))

    def pieces(x: Column, k: Column) -> Column:
        before, after = F.get("_turns", k - 1)["role"], F.get("_turns", k + 1)["role"]
        name = F.replace(escaped(x["role"]), F.lit("\n"), F.lit("&nl;"))
        start = F.when(before == x["role"], F.lit(SEP)).otherwise(F.concat(F.lit(HEAD), name, F.lit("\n")))
        end = F.when(after == x["role"], empty).otherwise(F.lit(END))
        part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(part(start, F.lit(False)), part(escaped(x["text"]), x["role"] == "assistant"), part(end, F.lit(False)))

    whole = sorted_turns.withColumn("segments", F.flatten(F.transform("_turns", pieces)))
    return whole.select(
        F.col("_conv").alias(conv), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""

    def block(b: Column) -> Column:
        name = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(name) + 2, F.length(b))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(unescaped(F.substring(name, len(HEAD) + 1, F.length(name))).alias("role"), unescaped(t).alias("text")))

    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def op3(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    done = format_chats(rows.union(extra))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    for raw, safe in ESCAPES:
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


OP3_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w IS NOT DISTINCT FROM role AS joins FROM t
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({_sql_escaped('text')}) + CASE WHEN joins THEN {len(SEP)}
        ELSE {len(HEAD) + 1 + len(END)} + length(replace({_sql_escaped('role')}, chr(10), '&nl;')) END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
