"""Chat formatting: conversations as training texts with a loss mask, by Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn, then role, then text (nulls first). Neighbours of
one role become one block, its parts told apart by a mark:

    ### user: first part<and/>second part</turn>
    ### assistant: answer</turn>

Texts and roles are escaped, so no mark occurs in them: a backslash is doubled, one is put behind the first character of a
mark (``<\\/turn>``) and behind each # that two more follow. Reading back removes single backslashes and halves double ones.
The loss mask covers the escaped texts of assistant parts and nothing else, as spans of code points of the formatted text.

Defined results: a null text or role is empty; rows without a conversation id are one conversation; equal rows stay, each is
a turn; an empty table gives no rows; columns besides the four named ones are left out. A conversation is one row of the
result, so it ends at the 2 GB that Spark allows a value; within that, the work is linear in the text but for the sums of
lengths (power 1.5 of the turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let, positions, running_totals

HEAD, MARK, END, PART = "### ", ": ", "</turn>\n", "<and/>"
LEARNED = "assistant"
#: What gets a backslash behind it.
ESCAPED = r"\\|<(?=/turn>|and/>)|#(?=##)"
#: Code points of the pieces from which spans are read.
PIECE = 4096


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _header(role: Column) -> Column:
    """The header of a block; in a role a colon before a space is escaped too, so that the first such pair ends the role."""
    return F.concat(F.lit(HEAD), F.regexp_replace(role, ESCAPED + "|:(?= )", r"$0\\"), F.lit(MARK))


def merged_turns(turns: Column) -> Column:
    """Sorted turns (turn, role, text) as blocks (role, texts), one for each run of equal roles."""

    def over(t: Column) -> Column:
        starts = F.filter(positions(t), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(starts, lambda s: F.transform(s, lambda i, k: block(F.slice(t, i + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - i))))

    def block(run: Column) -> Column:
        return F.struct(F.get(run, F.lit(0))["role"].alias("role"), F.transform(run, lambda x: x["text"]).alias("texts"))

    return let(turns, over)


def _pieces(blocks: Column) -> Column:
    """The pieces (text, loss) whose concatenation is the formatted text."""

    def plain(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def block(b: Column) -> Column:
        parts = F.transform(
            b["texts"], lambda x, i: F.array(plain(F.when(i == 0, "").otherwise(PART)), F.struct(escaped(x).alias("text"), (b["role"] == LEARNED).alias("loss")))
        )
        return F.concat(F.array(plain(_header(b["role"]))), F.flatten(parts), F.array(plain(F.lit(END))))

    return F.flatten(F.transform(blocks, block))


def _laid_out(pieces: Column) -> Column:
    """Struct (formatted, loss_spans) of pieces."""

    def over(p: Column) -> Column:
        ends = running_totals(F.transform(p, lambda x: F.char_length(x["text"]).cast("bigint")))
        learned = F.filter(positions(p), lambda i: F.get(p, i)["loss"])
        spans = let(ends, lambda e: F.transform(learned, lambda i: F.struct(F.get(e, i).alias("start"), F.get(e, i + 1).alias("end"))))
        return F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"), spans.alias("loss_spans"))

    return let(pieces, over)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text)."""
    turns = conversations.select("conv_id", F.struct("turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))).alias("turn"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return sorted_turns.select("conv_id", _laid_out(_pieces(merged_turns(F.col("turns")))).alias("out")).select("conv_id", "out.*")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted text."""

    def block(b: Column) -> Column:
        return let(F.instr(b, MARK), lambda at: parts(b, at))

    def parts(b: Column, at: Column) -> Column:
        role = unescaped(b.substr(F.lit(len(HEAD) + 1), at - (len(HEAD) + 1)))
        texts = F.split(b.substr(at + len(MARK), F.char_length(b)), PART, -1)
        return let(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescaped(x).alias("text"))))

    blocks = F.split(formatted, END, -1)
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), block))


def text_under(formatted: Column, spans: Column) -> Column:
    """The texts under spans of code points, unescaped.

    The text is cut once into pieces of fixed length, so that a span is found without counting from the beginning.
    """

    def read(pieces: Column, s: Column) -> Column:
        first, last = (F.floor(s[c] / PIECE).cast("int") for c in ("start", "end"))
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescaped(near.substr((s["start"] % PIECE).cast("int") + 1, (s["end"] - s["start"]).cast("int")))

    return let(F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), lambda p: F.transform(spans, lambda s: read(p, s)))
