"""Chat formatting checked by a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template. A text may hold one with backslashes after its first
# character; escaping adds a backslash, unescaping takes one away.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]))"
# turn := [INST] text [/INST] | [SYS] text [/SYS] | [ROLE] role [/ROLE] text </s> | text </s>
TURN = (
    r"(?s)\[INST\](?:.*?)\[/INST\]|\[SYS\](?:.*?)\[/SYS\]|"
    r"\[ROLE\](?:.*?)\[/ROLE\](?:.*?)</s>|(?!\[INST\]|\[SYS\]|\[ROLE\])(?:.*?)</s>"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _pieces(role: Column, text: Column) -> Column:
    """A rendered turn as before, body, after."""

    def struct(before, after):
        return F.struct(before.alias("before"), text.alias("body"), after.alias("after"))

    return (
        F.when(role == "user", struct(F.lit("[INST]"), F.lit("[/INST]")))
        .when(role == "system", struct(F.lit("[SYS]"), F.lit("[/SYS]")))
        .when(role == "assistant", struct(F.lit(""), F.lit("</s>")))
        .otherwise(struct(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]")), F.lit("</s>")))
    )


def _joined(pieces: Column) -> Column:
    return F.concat(pieces["before"], pieces["body"], pieces["after"])


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>, by the grammar alone."""

    def turn(t: Column) -> Column:
        def between(opening: str, closing: str) -> Column:
            return F.substring(t, F.lit(len(opening) + 1), F.char_length(t) - len(opening) - len(closing))

        inner = between("[ROLE]", "</s>")
        cut = F.instr(inner, "[/ROLE]")
        role, body = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + len("[/ROLE]"), F.char_length(inner))

        def told(role: Column, body: Column) -> Column:
            return F.struct(role.alias("role"), unescape(body).alias("text"))

        return (
            F.when(F.startswith(t, F.lit("[INST]")), told(F.lit("user"), between("[INST]", "[/INST]")))
            .when(F.startswith(t, F.lit("[SYS]")), told(F.lit("system"), between("[SYS]", "[/SYS]")))
            .when(F.startswith(t, F.lit("[ROLE]")), told(unescape(role), body))
            .otherwise(told(F.lit("assistant"), between("", "</s>")))
        )

    return F.transform(F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0)), turn)


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, turns, n_turns, escaped_turns.

    Turns are rendered one by one before any shuffle: first as they are, reparsed, and compared
    to the source; a turn that comes back otherwise has its text escaped until it comes back
    identical. `segments` are the pieces of the output in order, each with its loss flag, which is
    set for what the assistant says and nothing else; joined they are `formatted`. `turns` are
    read back from `formatted` by the parser, and the conversation fails if they are not the source.

    Turns stand by (turn, role, text), null turn numbers first; repeated rows are repeated turns.
    Null role or text counts as empty. Rows with a null conv_id form one conversation. Other
    columns are not read. Without rows there is no conversation.

    The text of a conversation ends in one row, as its output is one string; its turns travel
    rendered, and Spark groups them by conversation.
    """
    own = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain, escaped = _pieces(F.col("role"), F.col("text")), _pieces(F.col("role"), escape(F.col("text")))
    survives = F.coalesce(parse(_joined(plain)) == source, F.lit(False))
    turns = own.withColumn("survives", survives).select(
        "conv_id",
        F.struct(
            "turn", "role", "text", "survives", F.when(F.col("survives"), plain).otherwise(escaped).alias("pieces")
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(t["pieces"]["before"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["pieces"]["body"].alias("text"), (t["role"] == "assistant").alias("loss")),
                F.struct(t["pieces"]["after"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    rendered = grouped.select(
        "conv_id",
        "ts",
        F.filter(segments, lambda s: s["text"] != "").alias("segments"),
        F.array_join(F.transform("ts", lambda t: _joined(t["pieces"])), "").alias("formatted"),
    ).withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns") == F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rendered.select(
        "conv_id",
        "segments",
        "formatted",
        F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not survive its round trip"))).alias("turns"),
        F.size("ts").cast("long").alias("n_turns"),
        F.size(F.filter("ts", lambda t: ~t["survives"])).cast("long").alias("escaped_turns"),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
