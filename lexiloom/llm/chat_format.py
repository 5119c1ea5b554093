r"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>ROLE[INST] TEXT [/INST]</s>``. Control strings are
``<s> </s> [INST] [/INST]``. Where a role or a text holds one, or an escaped one,
a backslash is inserted after its bracket, and the parser takes one backslash
away: ``</s>`` is written ``<\/s>`` and ``<\/s>`` is written ``<\\/s>``.

The formatter renders a conversation plainly, parses it with the deterministic
parser, compares the recovered turns with the source and, where they differ or a role or
a text holds a control string, plain or escaped, renders it again with conflicting
content escaped; the result is parsed and compared again, and a conversation that
is not identical then fails the job. The parser takes a turn only where it follows
the grammar: all marks in their places and no unescaped control string in role or
text. All of it is column expressions over one row per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = r"</?s>|\[/?INST\]"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(turns: Column, escaped: bool) -> Column:
    """The formatted text of an array of (role, text)."""
    put = escape if escaped else (lambda c: c)
    each = F.transform(turns, lambda t: F.concat(F.lit(OPEN), put(t["role"]), F.lit(HEAD), put(t["text"]), F.lit(TAIL + CLOSE)))
    return F.array_join(each, "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted text; a piece that doesn't follow the grammar is a null, as is what stands after the last mark."""
    rest = F.element_at(F.split(formatted, CLOSE), -1)
    pieces = F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(F.split(formatted, CLOSE)) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, HEAD)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        start = at + F.lit(len(HEAD))
        text = F.substring(piece, start, F.length(piece) - F.lit(len(TAIL)) - start + F.lit(1))
        fits = piece.startswith(OPEN) & (at > 0) & piece.endswith(TAIL) & (F.length(piece) >= start + len(TAIL) - 1) & ~role.rlike(PLAIN) & ~text.rlike(PLAIN)
        return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(pieces, turn)
    return F.when(rest == "", turns).otherwise(F.array_append(turns, F.lit(None)))


def loss_spans(formatted: Column) -> Column:
    """Array of (start, length, text) in code points: the assistant texts inside the formatted text."""
    pieces = F.split(formatted, CLOSE)
    n = F.greatest(F.size(pieces) - 1, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,text:string>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        head = F.instr(piece, HEAD)
        role = F.substring(piece, F.lit(len(OPEN) + 1), head - F.lit(len(OPEN) + 1))
        first = head + F.lit(len(HEAD))
        length = F.length(piece) - F.lit(len(TAIL)) - first + F.lit(1)
        span = F.struct((acc["at"] + first - 1).alias("start"), length.alias("length"), F.substring(piece, first, length).alias("text"))
        return F.struct(
            (acc["at"] + F.length(piece) + F.lit(len(CLOSE))).alias("at"),
            F.when(unescape(role) == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(F.slice(pieces, 1, n), zero, step)["spans"]


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns, loss, escaped, identical``.

    ``turns`` and ``loss`` (start, length, text as it stands in ``formatted``) are
    read back from ``formatted``. Turns are ordered by ``turn``, ties by role and
    text, null turns first; repeated rows are kept. Null roles and texts are
    empty. Each row without ``conv_id`` is a conversation of its own.
    """
    own = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    df = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), own.alias("own"))
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    source = df.groupBy(F.col("conv").alias("conv_id"), "own").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    source = source.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), False))
    # a control string is a conflict by itself, also where the parser happens to get by with it
    clean = F.forall("source", lambda t: ~t["role"].rlike(CONTROL) & ~t["text"].rlike(CONTROL))
    plain = plain.withColumn("fits", clean & F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    done = plain.withColumn("formatted", F.when(F.col("fits"), F.col("plain")).otherwise(render(F.col("source"), True)))
    same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    done = done.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation can't be read back"))))
    return done.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        loss_spans(F.col("formatted")).alias("loss"),
        (~F.col("fits")).alias("escaped"),
        F.lit(True).alias("identical"),
    )
