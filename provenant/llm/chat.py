"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and its text as the only trainable part, marked by code-point offsets.
A conversation whose last turn is not the assistant's also gives one example
without trainable part, so that no turn is lost from the output.

A turn is written ``### Role: text </turn>`` and a newline. In roles and texts a
backslash, ``###`` and ``</turn>`` are escaped by a backslash before them, so
that the bare strings are always the template's own and reading back is exact.

A conversation is one training record and is put together as one row; the
expansion repeats its turns once for each reply, as the method asks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, SEP = "### ", " </turn>\n", ": "
#: Roles by their names in the template; any other is written after "=", null as "~".
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TOKEN = re.compile(r"\\(?:\\|###|</turn>|:)|### | </turn>\n")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def _header(role: Column) -> Column:
    named = F.when(role.isNull(), F.lit("~"))
    for key, name in ROLES.items():
        named = named.when(role == key, F.lit(name))
    return named.otherwise(F.concat(F.lit("="), F.regexp_replace(escape(role), ":", r"\\:")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_end), one row per example.

    target is the number of the trainable turn from 0, in order of turn (null
    first, ties by role and text), or the number of turns where the example
    has no trainable part. Offsets are code points, end exclusive. Null texts
    are empty; a null conv_id is a conversation of its own; empty input gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.col(role_col).cast("string")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.select("conv_id", F.transform("ts", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False))).alias("replies"), F.transform("ts", lambda t: F.concat(F.lit(OPEN), _header(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(CLOSE))).alias("pieces"))
    n = F.size("pieces")
    chosen = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("replies", i))
    chosen = F.when(F.get("replies", n - 1), chosen).otherwise(F.concat(chosen, F.array(n)))
    each = convs.select("conv_id", "pieces", F.explode(chosen).alias("target"))
    whole = F.array_join(F.slice("pieces", F.lit(1), F.col("target") + 1), "")
    made = each.select("conv_id", "target", whole.alias("formatted"), F.get("pieces", F.col("target")).alias("last"))
    start = F.length("formatted") - F.length("last") + len(OPEN) + len(ROLES["assistant"]) + len(SEP)
    return made.select("conv_id", F.col("target").cast("long").alias("target"), "formatted", start.cast("long").alias("loss_start"), F.when(F.col("last").isNotNull(), F.length("formatted") - len(CLOSE)).cast("long").alias("loss_end"))


def read_back(formatted: str) -> list[tuple[str | None, str]]:
    """The (role, text) turns of a formatted example: the exact inverse of the template."""
    turns, at = [], None
    names = {v: k for k, v in ROLES.items()}
    for m in _TOKEN.finditer(formatted):
        if m.group() == OPEN and at is None:
            at = m.end()
        elif m.group() == CLOSE:
            head, _, body = _split(formatted[at : m.start()])
            role = None if head == "~" else _ESCAPED.sub(r"\1", head[1:]) if head[0] == "=" else names[head]
            turns.append((role, _ESCAPED.sub(r"\1", body)))
            at = None
    return turns


def _split(piece: str) -> tuple[str, str, str]:
    m = re.match(r"((?:\\.|[^:\\])*)(: )", piece, re.DOTALL)
    return m[1], m[2], piece[m.end() :]


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts")]))
def parsed(formatted: pd.Series) -> pd.DataFrame:
    turns = [read_back(x) for x in formatted]
    return pd.DataFrame({"roles": [[r for r, _ in t] for t in turns], "texts": [[x for _, x in t] for t in turns]})


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their text."""
    reply = F.regexp_replace(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")), r"\\(\\|###|</turn>)", "$1")
    per = examples.select("conv_id", "target", "formatted", F.coalesce(reply, F.lit("")).alias("reply"))
    by = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("target", "reply"))).alias("replies"), F.max(F.struct("target", "formatted")).alias("longest"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    by = by.select("conv_id", "formatted_chars", loss.alias("loss"), parsed(F.col("longest.formatted")).alias("p"))
    lines = F.array_join(F.transform(F.arrays_zip("p.roles", "p.texts"), lambda t: F.concat(F.coalesce(t["roles"], F.lit("")), F.lit("\n"), t["texts"], F.lit("\n"))), "")
    return by.select("conv_id", F.size("p.texts").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
