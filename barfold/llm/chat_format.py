"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, then
the turn itself, of which only the text is trained on. A turn is written as
``<turn role="ROLE">TEXT</turn>`` and a line feed. Inside roles and texts ``&``, ``<`` and
``"`` are written as references, so that no text can hold a control string, and reading
back is exact.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
#: Control characters of the template and how texts write them; undone from last to first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def examples(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id, example, n_turns, formatted, loss_start, loss_chars``: one row per example.

    ``example`` counts from 1 in a conversation; ``formatted`` is context and target; the
    trained text is ``loss_chars`` code points (bigint) from ``loss_start`` (from 1). Turns
    behind the last assistant turn make a last example that trains nothing
    (``loss_chars`` 0), so no turn is lost. Turns are ordered by turn, role, text; a null turn
    comes first (a conversation is put together in one row, as its last example is one text),
    null roles and texts count as empty, repeated rows stay, rows with a null
    ``conv_id`` form one conversation, an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = talks.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == trained_role).alias("trained"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
    )
    pieces = F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(CLOSE)))
    last = F.size("trained")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("trained", i) | (i == last))
    spread = written.select("*", pieces.alias("pieces"), F.posexplode(ends).alias("at", "end"))
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("end") - 1), "")
    head, text = F.element_at("heads", F.col("end")), F.element_at("texts", F.col("end"))
    return spread.withColumn("context", context).select(
        "conv_id", (F.col("at") + 1).cast("bigint").alias("example"), F.col("end").cast("bigint").alias("n_turns"),
        F.concat("context", head, text, F.lit(CLOSE)).alias("formatted"),
        (F.char_length("context") + F.char_length(head) + 1).cast("bigint").alias("loss_start"),
        F.when(F.element_at("trained", F.col("end")), F.char_length(text)).otherwise(0).cast("bigint").alias("loss_chars"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text"),
    ))


def trained_text() -> Column:
    """The text under the loss mask of an example, read back."""
    return unescape(F.substr("formatted", F.col("loss_start").cast("int"), F.col("loss_chars").cast("int")))
