r"""Chat formatting with typed content parts.

A visitor turns each part of a message (text, image, audio, document) into text or an ordered placeholder, records every
attachment with its reference and the tokens its placeholder expands to, and the turns of a conversation become one string:

    <turn ROLE>BODY</turn>\n

``<``, ``>`` and ``\`` inside roles, texts and references are written ``\l``, ``\g`` and ``\b``, so no control string can come from
content, and unescape() restores it exactly. The loss mask is an array of code-point spans over the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"

#: Placeholder costs: image tokens per 28 x 28 patch, audio tokens a second, document tokens a page; and the cost if the size is unknown.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
UNKNOWN = {"image": 256, "audio": 750, "document": 512}


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain message as an array of one text part."""
    null = {k: F.lit(None).cast(t) for k, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[v.alias(k) for k, v in null.items()]))


def part_tokens(p: Column) -> Column:
    image = F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH)
    audio = F.ceil(p["seconds"] * AUDIO_RATE)
    document = p["pages"].cast("bigint") * PAGE_TOKENS
    return (
        F.when(p["type"] == "image", F.coalesce(image, F.lit(UNKNOWN["image"])))
        .when(p["type"] == "audio", F.coalesce(audio, F.lit(UNKNOWN["audio"])))
        .when(p["type"] == "document", F.coalesce(document, F.lit(UNKNOWN["document"])))
        .otherwise(F.lit(0)).cast("bigint")
    )


def visit(p: Column, i: Column) -> Column:
    """One part as text of the body. i is its place among the message's parts."""
    mark = F.concat(F.lit("<"), p["type"], F.lit(" "), i.cast("string"), F.lit(" "), escape(p["ref"]), F.lit(">"))
    return F.when(p["type"].isin("image", "audio", "document"), mark).otherwise(escape(p["text"]))


def format_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                         loss_role: str = "assistant") -> DataFrame:
    """messages: one row per message with an array<PART> column. Returns one row per conversation:

    conv_id, formatted, loss (array of start and n: code points, from 0), attachments (turn, place, type, ref, tokens, in
    order), attachment_tokens.

    Messages are ordered by turn, then role, then body, so ties and repeated rows have one order; null turns come first. Null
    conversation ids form one conversation. Null roles, texts and part lists are empty; parts of an unknown type count as text.
    Other columns are ignored. An empty table gives no rows.
    """
    p = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    body = F.array_join(F.transform(p, visit), "")
    found = F.filter(
        F.transform(p, lambda x, i: F.struct(F.col(turn).cast("bigint").alias("turn"), i.alias("place"), x["type"].alias("type"), x["ref"].alias("ref"), part_tokens(x).alias("tokens"))),
        lambda x: x["type"].isin("image", "audio", "document"),
    )
    rows = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        body.alias("body"), found.alias("found"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    rows = rows.select("*", F.concat(head, "body", F.lit(CLOSE)).alias("seg"), F.length(head).alias("head"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.select(
        "conv_id", "seg", "found",
        F.row_number().over(order).alias("k"),
        F.when(F.col("role") == loss_role, F.struct(
            (F.coalesce(F.sum(F.length("seg")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("head")).alias("start"),
            F.length("body").cast("bigint").alias("n"),
        )).alias("span"),
    )
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "seg", "span", "found"))).alias("t"))
    out = g.select(
        "conv_id",
        F.array_join(F.col("t.seg"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.col("t.found")).alias("attachments"),
    )
    return out.select("*", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of role and text, unescaped. Placeholders stay as they are."""
    pattern = F.lit(r"(?s)<turn ([^>]*)>(.*?)</turn>\n")
    roles, bodies = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(unescape(r).alias("role"), unescape(b).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["n"].cast("int")))), "")


#: The conversation that the registered query adds (fixed values).
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    messages = table.unionByName(added).withColumn("parts", text_parts(F.col("text")))
    out = format_conversations(messages).select("*", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"), F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'), (-7::BIGINT, 1::BIGINT, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS body,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS erole FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, body), '')) AS loss_sha256,
  sum(15 + length(erole) + length(body))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
