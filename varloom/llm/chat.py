"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template (one line break between turns)::

    ### Role: text</turn>\\n

The roles user, assistant and system are shown as User, Assistant and System; any
other role is shown as it is. The grammar reads this back deterministically: pieces
end at ``</turn>\\n``, the label ends at the first ``: ``, and a backslash makes the
character after it literal. Each turn is first rendered as it is and parsed again;
where the parse differs from the source or the text holds a control string
(``###`` or ``</turn>``), that turn is rendered with its conflicting characters
escaped (``\\\\``, ``\\#``, ``<\\/turn>``), which always reads back identically.
``format_conversations`` checks the read-back of every turn and raises otherwise.

The loss mask marks the assistant texts: one (piece, start, length) in code points
per assistant turn. Null text or role counts as empty; a null conv_id is one
conversation of its own; turns are ordered by (turn, role, text), nulls first, so
ties and repeated rows have a fixed order and all stay. A conversation is one
output value: its turns meet in one row, as the format demands, and nothing larger.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD = "### "
LABEL_END = ": "
TURN_END = "</turn>\n"
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
LOSS_ROLE = "assistant"


def _escape(text: Column) -> Column:
    marked = F.regexp_replace(text, r"[\\#]", r"\\$0")
    return F.regexp_replace(marked, r"<(?=/turn>)", r"<\\")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _label(role: Column) -> Column:
    """The role as shown; one that could be misread gets a backslash before each risky character."""
    literal = F.replace(_escape(role), F.lit(LABEL_END), F.lit(":\\ "))
    label = F.when(role.isin(*SHOWN.values()), F.concat(F.lit("\\"), literal)).otherwise(literal)
    for name, shown in SHOWN.items():
        label = F.when(role == name, F.lit(shown)).otherwise(label)
    return label


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), _label(role), F.lit(LABEL_END), text)


def parse_piece(piece: Column) -> Column:
    """struct(role, text, start, length) of one piece, the text of the turn unescaped.

    ``start`` and ``length`` locate the raw (still escaped) text in the piece.
    """
    after = F.substring(piece, len(HEAD) + 1, 2**31 - 1)
    label = F.substring_index(after, LABEL_END, 1)
    role = _unescape(label)
    for name, shown in SHOWN.items():
        role = F.when(label == shown, F.lit(name)).otherwise(role)
    start = F.lit(len(HEAD) + len(LABEL_END)) + F.length(label)
    raw = F.substr(piece, start + 1)
    return F.struct(
        role.alias("role"), _unescape(raw).alias("text"), start.alias("start"), F.length(raw).alias("length")
    )


def parse_conversation(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order."""
    pieces = F.split(formatted, TURN_END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse_piece)


def render_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``piece``: the turn as rendered, escaped only where it must be."""
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    plain = rows.withColumn("plain", _piece(F.col("role"), F.col("text")))
    # The turn's own reading: all pieces that the grammar sees in it, not only the first.
    seen = plain.withColumn("seen", parse_conversation(F.concat("plain", F.lit(TURN_END))))
    same = (
        (F.size("seen") == 1)
        & (F.col("seen")[0]["role"] == F.col("role"))
        & (F.col("seen")[0]["text"] == F.col("text"))
        & ~F.contains(F.col("text"), F.lit("###"))
        & ~F.contains(F.col("text"), F.lit("</turn>"))
    )
    piece = F.when(same, F.col("plain")).otherwise(_piece(F.col("role"), _escape(F.col("text"))))
    return seen.select("conv_id", "turn", "role", "text", piece.alias("piece"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (piece, start, length of each assistant text)."""
    rendered = render_turns(turns)
    back = parse_piece(F.col("piece"))
    checked = rendered.withColumn("back", back).withColumn(
        "piece",
        F.when((F.col("back.role") == F.col("role")) & (F.col("back.text") == F.col("text")), F.col("piece"))
        .otherwise(F.raise_error(F.concat(F.lit("no round trip in conversation "), F.col("conv_id").cast("string")))),
    )
    one = F.struct(
        "turn", "role", "text", "piece", F.col("back.start").alias("start"), F.col("back.length").alias("length")
    )
    whole = checked.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    spans = F.filter(
        F.transform(
            "all",
            lambda t, i: F.when(
                t["role"] == LOSS_ROLE, F.struct(i.alias("piece"), t["start"].alias("start"), t["length"].alias("length"))
            ),
        ),
        lambda s: s.isNotNull(),
    )
    text = F.concat(F.array_join(F.transform("all", lambda t: t["piece"]), TURN_END), F.lit(TURN_END))
    return whole.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the output sees: turns and the text under the loss mask, per conversation."""
    pieces = F.split("formatted", TURN_END)
    loss = F.transform(
        "loss_spans", lambda s: _unescape(F.substr(F.get(F.col("pieces"), s["piece"]), s["start"] + 1, s["length"]))
    )
    return formatted.withColumn("pieces", pieces).select(
        "conv_id", "formatted", parse_conversation(F.col("formatted")).alias("turns"), loss.alias("loss")
    )
