r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, one turn after the other and nothing between them::

    user       [INST] text [/INST]        system    [SYS] text [/SYS]
    assistant  [ANS] text </s>            others    [ROLE hex-of-role] text [/ROLE]

A turn is first rendered as it is and parsed again by the grammar (header, shortest text up to a closing mark). A turn that
does not come back identical holds control strings: they are escaped by one backslash behind their bracket (``</s>`` becomes
``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), which unescaping takes away again, and the header says so (``[INST+]``). Escaped
text holds no control string, so that one round makes every turn identical; a turn that still differed would end the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
_NAMES = r"(?:/?(?:INST|SYS|ANS|ROLE)\+?(?: [0-9A-F]*)?\]|/?s>)"
_CONTROL = rf"([<\[])(\\*)({_NAMES})"
_ESCAPED = rf"([<\[])\\(\\*)({_NAMES})"
_TURN = r"(?s)\[(INST|SYS|ANS|ROLE [0-9A-F]*)(\+?)\] (.*?) (?:\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(role: Column, text: Column, mark: Column) -> Column:
    """One turn; ``mark`` is + if the text is escaped, else empty."""
    wrap = lambda name, end: F.concat(F.lit(f"[{name}"), mark, F.lit("] "), text, F.lit(f" {end}"))
    return (F.when(role == "user", wrap("INST", "[/INST]")).when(role == "system", wrap("SYS", "[/SYS]"))
            .when(role == "assistant", wrap("ANS", "</s>"))
            .otherwise(F.concat(F.lit("[ROLE "), F.hex(role), mark, F.lit("] "), text, F.lit(" [/ROLE]"))))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted string, unescaped where the header says so."""
    def turn(x: Column) -> Column:
        kind = F.regexp_extract(x, _TURN, 1)
        body = F.regexp_extract(x, _TURN, 3)
        role = (F.when(kind == "INST", "user").when(kind == "SYS", "system").when(kind == "ANS", "assistant")
                .otherwise(F.decode(F.unhex(F.substring(kind, 6, 1 << 30)), "UTF-8")))
        return F.struct(role.alias("role"),
                        F.when(F.regexp_extract(x, _TURN, 2) == "+", unescape(body)).otherwise(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def round_trip(turns: DataFrame) -> DataFrame:
    """``turns`` (role, text) with ``formatted``: the rendered turn, escaped only where the plain one is not recovered."""
    def recovered(column: str) -> Column:
        back = parse(F.col(column))
        whole = F.length(column) == F.length(F.regexp_extract(F.col(column), _TURN, 0))
        return (F.size(back) == 1) & whole & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))

    plain = turns.withColumn("formatted", render(F.col("role"), F.col("text"), F.lit("")))
    chosen = plain.withColumn("formatted", F.when(
        F.coalesce(recovered("formatted"), F.lit(False)), F.col("formatted")).otherwise(
            render(F.col("role"), escape(F.col("text")), F.lit("+"))))
    return chosen.withColumn("formatted", F.when(F.coalesce(recovered("formatted"), F.lit(False)), F.col("formatted"))
                             .otherwise(F.raise_error(F.lit("a turn cannot be recovered from its rendered form"))))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text; read back from ``formatted``) of rows (conv_id, turn, role, text).

    Rows are ordered by turn (null first), then role and text; repeated rows are turns of their own. A null role or text
    counts as empty, a null conv_id is a conversation. No rows give no rows; further columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    done = round_trip(rows).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("all"))
    return (done.select("conv_id", F.array_join(F.col("all.formatted"), "").alias("formatted"))
            .withColumn("turns", parse(F.col("formatted"))))


def report(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    found = conversations(turns)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (found.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars")))
