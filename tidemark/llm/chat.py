"""Relational chat formatting (DataFrame and SQL functions only).

A block is a run of adjacent turns with one role::

    ### role: first text<more/>second text</turn>\\n

Inside roles and texts the control strings are escaped, and the backslash that begins an escape with them, so a
formatted conversation can be read back to its turns whatever they contain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In this order when escaping; a backslash of the text goes first, and comes back last.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"), ("<more/>", "\\m"))
#: Code points of the pieces that a formatted text is cut into for reading its spans.
PIECE = 256
#: Roles end at the first colon, so theirs are escaped too.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def format_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation.

    ``loss_spans`` are 0-based [from, to) code points of ``formatted``, one for each turn whose role is ``learn``.
    Turns are ordered by (turn, role, text), a null turn first; repeated rows stay. A null text or role is empty; rows
    with a null conversation id make one conversation. Without turns there is no row. Other columns of ``turns`` are left
    out. A conversation is one row of the output, so it is gathered whole, whatever its length.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = sorted_turns.withColumn("starts", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role != turns[i - 1].role)"))
    blocks = starts.select(
        "conv_id",
        F.expr(
            """transform(starts, (s, b) -> named_struct('role', turns[s].role, 'texts',
                 transform(slice(turns, s + 1, if(b + 1 < size(starts), starts[b + 1], size(turns)) - s), t -> t.text)))"""
        ).alias("blocks"),
    )
    pieces = blocks.select(
        "conv_id",
        F.transform(
            "blocks",
            lambda b: F.struct(
                (b["role"] == learn).alias("learn"),
                F.concat(F.lit("### "), escaped(b["role"], ROLE_ESCAPES), F.lit(": ")).alias("head"),
                F.transform(b["texts"], lambda t: escaped(t)).alias("texts"),
            ),
        ).alias("pieces"),
    )
    built = pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], F.array_join(p["texts"], "<more/>"), F.lit("</turn>\n"))), "").alias("formatted"),
        # lengths alone: the place of each text follows from sums over them
        F.flatten(
            F.transform(
                "pieces",
                lambda p: F.transform(
                    p["texts"],
                    lambda t, i: F.struct(
                        F.when(i == 0, F.length(p["head"])).otherwise(F.lit(len("<more/>"))).alias("gap"),
                        F.length(t).alias("n"),
                        F.when(i == F.size(p["texts"]) - 1, F.lit(len("</turn>\n"))).otherwise(F.lit(0)).alias("tail"),
                        p["learn"].alias("learn"),
                    ),
                ),
            )
        ).alias("lengths"),
    )
    # growing an array copies it, so sums run over stretches of as many texts as there are stretches
    stretches = "transform(sequence(1, size(lengths), cast(ceil(sqrt(size(lengths))) as int)), i -> slice(lengths, i, cast(ceil(sqrt(size(lengths))) as int)))"
    begins = """aggregate(stretches, named_struct('at', 0, 'begins', cast(array() as array<int>)), (s, x) -> named_struct(
                  'at', s.at + aggregate(x, 0, (n, y) -> n + y.gap + y.n + y.tail), 'begins', concat(s.begins, array(s.at)))).begins"""
    spans = """flatten(transform(stretches, (x, i) -> aggregate(x, named_struct('at', begins[i], 'spans', cast(array() as array<struct<from:int,to:int>>)),
                 (s, y) -> named_struct('at', s.at + y.gap + y.n + y.tail, 'spans',
                   if(y.learn, concat(s.spans, array(named_struct('from', s.at + y.gap, 'to', s.at + y.gap + y.n))), s.spans))).spans))"""
    built = built.withColumn("stretches", F.expr(stretches)).withColumn("begins", F.expr(begins))
    return built.select("conv_id", "formatted", F.expr(spans).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_texts array<string>) parsed from the output alone."""
    block = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            block,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate(": ", b) + 2), "<more/>"),
                lambda t: F.struct(unescaped(F.substr(b, F.lit(5), F.locate(": ", b) - 5), ROLE_ESCAPES).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    # a place in a text is found by walking to it, so the text is cut into pieces once and a span takes those it lies in;
    # the pieces are bound by a lambda, for an expression within one would be made anew for each span
    pieces = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    first = lambda s: F.floor(s["from"] / PIECE).cast("int")
    held = lambda p, s: F.array_join(F.slice(p, first(s) + 1, F.floor((F.greatest(s["to"], s["from"] + 1) - 1) / PIECE).cast("int") - first(s) + 1), "")
    loss = F.transform(F.array(pieces), lambda p: F.transform("loss_spans", lambda s: unescaped(F.substr(held(p, s), s["from"] % PIECE + 1, s["to"] - s["from"]))))[0]
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def op5_chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7 formatted, read back and digested.

    Null texts and roles are empty, rows with a null id are one conversation, repeated rows and ties count each; without
    conversations there is -7 alone. Other columns are left out.
    """
    trap = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(rows))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, row_number() OVER w AS rn, coalesce(lag(role) OVER w != role, true) AS opens,
         replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t'), '<more/>', '\m') AS etext,
         replace(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), '<more/>', '\m'), ':', '\c') AS erole
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN opens THEN 6 + length(erole) + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
