"""Chat formatting from event logs, with DataFrame functions only.

A log holds message, delta, edit and regenerate events. Its messages are rebuilt by folding the events of each
message in order of their sequence number, then those of each conversation are rendered with a template that escapes
its control strings inside texts, so that the rendered string can be read back exactly. Loss spans mark assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that no escaped text holds: the template's own, and those of other common templates.
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def escaped(c: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def rebuilt(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log as in EVENTS.

    message opens a turn with its text, delta appends, edit replaces the text, regenerate empties it and drops every
    later turn whose events all came before. The last message event gives the role. Events of one turn that share a
    seq are taken in order of kind and text; null texts are empty; a turn of which nothing opened is opened by its
    first event. Null ids and turns are values of their own. All events of one message meet in one group, and all
    messages of one conversation: what a rendered string needs anyway.
    """
    resets = F.col("kind").isin("message", "edit", "regenerate")
    opened = F.max(F.when(resets, F.col("seq")))
    turn = Window.partitionBy("conv_id", "turn")
    e = events.select("conv_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("__from", opened.over(turn))
    folded = e.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.when(F.col("__from").isNull() | (F.col("seq") >= F.col("__from")), F.struct("seq", F.when(F.col("kind") == "delta", 1).otherwise(0), "text")))).alias("parts"),
        F.max_by("role", F.struct((F.col("kind") == "message").alias("m"), "seq")).alias("role"),
        F.max("seq").alias("last"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    kept = folded.withColumn("cut", F.max("again").over(earlier)).where("cut is null or last > cut")
    return kept.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation; loss holds (begin, length) in code points, escaped.

    A turn is OPEN, role, line feed, text, CLOSE, line feed. A line feed in a role is escaped too.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escaped(F.col("text"))
    one = messages.select("conv_id", F.struct("turn", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss")).alias("t"))
    grouped = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    tail = CLOSE + "\n"
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(tail)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("spans"))

    def step(acc, t):
        span = F.struct((acc["at"] + F.length(t["head"])).alias("begin"), F.length(t["body"]).alias("length"))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return grouped.select("conv_id", whole.alias("formatted"), F.aggregate("turns", start, step, lambda a: a["spans"]).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from rendered strings: turns of (role, text), and what the mask covers."""
    pieces = F.slice(F.split("formatted", f"\\Q{OPEN}\\E", -1), 2, 1 << 30)
    # the first line feed that no backslash precedes ends the role
    role = lambda p: F.regexp_extract(p, r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)

    def turn(p):
        r = role(p)
        body = F.substring(p, F.length(r) + 2, F.length(p) - F.length(r) - 1 - len(CLOSE) - 1)
        return F.struct(unescaped(r).alias("role"), unescaped(body).alias("text"))

    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["begin"] + 1, s["length"]))), "")
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def as_log(conversations: DataFrame, pieces: int = 4) -> DataFrame:
    """conversations(conv_id, turn, role, text) as the log of a service that streams, edits and regenerates.

    Rows are numbered by turn, then role and text, so rows that share a turn stay separate messages. Each text ends as
    `pieces` deltas. Before these, rows of the third kind (by number modulo 3) only open a message; those of the first
    have a draft edited away; those of the second a draft and a reply to it, in the next turn, both taken back when the
    turn is regenerated. Folded, the log gives the rows back. An empty table gives an empty log; nulls are as in rebuilt.
    """
    at = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(at).cast("long").alias("turn"))
    turn, role, text, way = F.col("turn"), F.col("role"), F.col("text"), F.col("turn") % 3
    draft, size = F.concat(F.lit("draft: "), F.coalesce(text, F.lit(""))), F.ceil(F.length(text) / pieces).cast("int")

    def event(k, kind, said, of=turn, by=role):
        return F.struct((turn * (pieces + 8) + k).alias("seq"), F.lit(kind).alias("kind"), of.alias("turn"), by.alias("role"), said.alias("text"))

    none = F.lit("")
    opening = (
        F.when(way == 1, F.array(event(0, "message", none), event(1, "delta", draft), event(2, "edit", none)))
        .when(way == 2, F.array(event(0, "message", draft), event(1, "message", none, turn + 1, F.lit("user")), event(2, "delta", draft, turn + 1, F.lit("user")), event(3, "regenerate", none)))
        .otherwise(F.array(event(0, "message", none)))
    )
    streamed = F.array(*(event(4 + k, "delta", F.substring(text, F.lit(k) * size + 1, size)) for k in range(pieces)))
    return rows.select("conv_id", F.inline(F.concat(opening, streamed)))


_ESC = "replace({0}, '\\', '\\\\')"
for _s in CONTROLS:
    _ESC = f"replace({_ESC}, '{_s}', '{_s[0]}\\{_s[1:]}')"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 1
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 2
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(OPEN) + len(CLOSE) + 2} + length(replace({_ESC.format('role')}, chr(10), '\\' || chr(10))) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
