"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar of a formatted conversation:
    conversation = "<s>" turn*
    turn  = "[INST] " body "[/INST]"                    role user
          | "[OUT] " body "</s>"                         role assistant
          | "[SYS] " body "[/SYS]"                      role system
          | "[ROLE " body "] " body "[/ROLE]"           any other role
    body  = (any character but [ ] < \\, or a backslash and any character)*
Each turn is first rendered as it is and parsed again. Where the parser doesn't give the turn back, the
text holds a control character; those characters then get a backslash, which parsing takes off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BODY = r"(?:[^\[\]<\\]++|\\.)*+"
TURN = (
    rf"(?s)\[INST\] ({BODY})\[/INST\]|\[OUT\] ({BODY})</s>|\[SYS\] ({BODY})\[/SYS\]"
    rf"|\[ROLE ({BODY})\] ({BODY})\[/ROLE\]"
)
#: Where a turn ends: its closing mark, which no body can hold.
KINDS = (("user", "[INST] ", "[/INST]"), ("assistant", "[OUT] ", "</s>"), ("system", "[SYS] ", "[/SYS]"))
CONTROL = r"([\[\]<\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, body: Column) -> Column:
    """One turn of the grammar; role of a known kind, or already escaped."""
    other = F.concat(F.lit("[ROLE "), role, F.lit("] "), body, F.lit("[/ROLE]"))
    out = F.when(role == KINDS[0][0], F.concat(F.lit(KINDS[0][1]), body, F.lit(KINDS[0][2])))
    for name, head, tail in KINDS[1:]:
        out = out.when(role == name, F.concat(F.lit(head), body, F.lit(tail)))
    return out.otherwise(other)


def parse_turn(turn: Column) -> Column:
    """struct(role, body): what the grammar reads from one rendered turn; body is still escaped."""
    part = lambda k: F.regexp_extract(turn, TURN, k)
    role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    picked = F.when(F.lit(False), F.struct(role.alias("role"), body.alias("body")))
    for k, (name, head, _) in enumerate(KINDS, 1):
        picked = picked.when(F.startswith(turn, F.lit(head)), F.struct(F.lit(name).alias("role"), part(k).alias("body")))
    return picked.otherwise(F.struct(unescape(part(4)).alias("role"), part(5).alias("body")))


def parse_conversation(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, body>>."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse_turn)


def _as_source(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit("\n"), text, F.lit("\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row a conversation.

    Columns: conv_id, formatted, turns (array<struct<role, text>> read back from formatted), loss_spans
    (array<struct<start, end>>: code points of formatted that hold assistant bodies), same (the parser
    gives exactly the source back). A null text or role counts as empty; a null conv_id is a conversation
    of its own; null turns come first; rows with the same turn follow by role and text. No rows give no
    conversation. Other columns are ignored. A conversation is one row, so its size is bounded by what one
    row can hold.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    kinds = [k for k, _, _ in KINDS]
    shown = F.when(F.col("role").isin(kinds), F.col("role")).otherwise(escape(F.col("role")))
    plain = render(shown, F.col("text"))
    whole = F.regexp_extract(plain, TURN, 0) == plain
    back = parse_turn(plain)
    fits = whole & (back["role"] == F.col("role")) & (unescape(back["body"]) == F.col("text"))
    rows = rows.select("*", F.when(fits, plain).otherwise(render(shown, escape(F.col("text")))).alias("shown"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"n": F.row_number().over(order), "upto": F.sum(F.length("shown")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    head, tail = len(KINDS[1][1]), len(KINDS[1][2])
    start = F.lit(3) + F.col("upto") - F.length("shown") + head
    item = F.struct("n", "role", "text", "shown", F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (F.col("upto") + 3 - tail).alias("end"))).alias("span"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    convs = convs.select("conv_id", "t", F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda x: x["shown"]), "")).alias("formatted"))
    read = F.transform(parse_conversation(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), unescape(x["body"]).alias("text")))
    convs = convs.withColumn("turns", read)
    return convs.select(
        "conv_id", "formatted", "turns",
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        (F.col("turns") == F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("same"),
    )


def digests(convs: DataFrame) -> DataFrame:
    """Counts and digests of what formatted conversations hold; the loss text is cut out by its spans."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    source = F.array_join(F.transform("turns", lambda x: _as_source(x["role"], x["text"])), "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(source, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "same",
    )
