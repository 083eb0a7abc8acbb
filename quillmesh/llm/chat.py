"""Chat formatting with typed content parts (operator 6), DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, tokens). The visitor flattens the parts in
order: text is escaped and kept, an image, audio or document part becomes a numbered placeholder
`<|kind:i|>`, its reference goes to `attachments` with its place, and its tokens to `expanded_tokens`.

Template of a turn: `<|role|>` newline, content `<|end|>` newline. Control strings inside texts and
roles are escaped reversibly: every backslash is doubled, then a backslash is put into `<s>`, `</s>`,
`[INST]`, `[/INST]`, `<|` and `|>`. `loss_spans` are the code-point spans of assistant content.

Rows of a conversation go by turn, then role, then text; null roles and texts are empty; null turns
come first; a null conv_id is a conversation of its own; repeated rows are repeated turns; an unknown
kind of part is a document. A conversation without rows has no output. A conversation is one output
value, so its rows meet in one row by definition; nothing else is gathered. Texts are taken whole, however
long. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.util import table

# Control strings of the template and of common chat formats (fixed values).
CONTROL = r"([<\[])(?=/?s>|/?INST\]|\|)"
KINDS = ("image", "audio", "document")
END = "<|end|>\n"


def escape(s: Column) -> Column:
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    s = F.regexp_replace(s, F.lit(CONTROL), F.lit("$1\\\\"))
    return F.regexp_replace(s, F.lit(r"\|(?=>)"), F.lit("|\\\\"))


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def visit(parts: Column) -> Column:
    """Flatten parts: struct of body, attachments (kind, ref, at: code point in the body) and tokens."""
    kind = lambda p: F.when(p["kind"].isin("text", *KINDS), p["kind"]).otherwise(F.lit("document"))
    zero = F.struct(F.lit("").alias("body"), F.array().cast("array<struct<kind:string,ref:string,at:bigint>>").alias("attachments"), F.lit(0).cast("long").alias("tokens"))

    def step(acc, p):
        is_text = kind(p) == "text"
        mark = F.concat(F.lit("<|"), kind(p), F.lit(":"), F.size(acc["attachments"]).cast("string"), F.lit("|>"))
        one = F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), F.length(acc["body"]).cast("long").alias("at"))
        return F.struct(
            F.concat(acc["body"], F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)).alias("body"),
            F.when(is_text, acc["attachments"]).otherwise(F.concat(acc["attachments"], F.array(one))).alias("attachments"),
            (acc["tokens"] + F.when(is_text, F.lit(0)).otherwise(F.coalesce(p["tokens"], F.lit(0)))).cast("long").alias("tokens"),
        )

    return F.aggregate(parts, zero, step)


def format_chats(df: DataFrame, parts: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text or `parts`) to a row per conversation: formatted, loss_spans, attachments, expanded_tokens."""
    role = F.coalesce(F.col("role"), F.lit(""))
    t = df.select("conv_id", F.col("turn"), role.alias("role"), visit(F.col(parts) if parts else text_parts(F.col("text"))).alias("v"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("v.body").alias("body"), F.col("v.attachments").alias("attachments"), F.col("v.tokens").alias("tokens")))).alias("turns"))
    head = lambda x: F.concat(F.lit("<|"), escape(x["role"]), F.lit("|>\n"))
    t = t.withColumn("pieces", F.transform("turns", lambda x: F.struct(head(x).alias("head"), x["body"].alias("body"), (x["role"] == "assistant").alias("loss"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def place(acc, x):
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return t.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")).alias("formatted"),
        F.aggregate("pieces", zero, place)["spans"].alias("loss_spans"),
        F.flatten(F.transform("turns", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(i.alias("turn_index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["at"].alias("at"))))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay in the text as they are."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n", -1), 1, F.size(F.split(formatted, r"<\|end\|>\n", -1)) - 1)
    head = r"(?s)^<\|(.*?)\|>\n"
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def op6(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    f = format_chats(chats.unionByName(extra))
    f = f.withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    f = f.withColumn("loss", loss)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|\|)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), '\|>', '|\\>', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
