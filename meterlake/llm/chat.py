"""Chat formatting with relational and array expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import let

TURN, SAYS, PART, END = "<|turn|>", "<|says|>", "<|part|>", "<|end|>\n"
TRAINED = "assistant"
#: Turns are first joined in groups of so many turn numbers, then the groups of a conversation.
GROUP = 256

#: What follows ``<`` or ``[`` in a control string, with any number of backslashes between.
_REST = r"(\|[A-Za-z_]{1,32}\|>|/?s>|/?INST\]|/?SYS>)"


def escape(text: Column) -> Column:
    r"""One more backslash between the bracket and the rest of a control string: ``</s>`` becomes ``<\/s>``."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text, loss).

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are sorted by turn (nulls first), then
    role and text, so ties and repeated rows have a fixed order and all are kept. Null roles and texts are empty; turns
    with a null conv_id form one conversation. Adjacent turns of one role share a block:

        <|turn|>role<|says|>text<|part|>text<|end|>

    Control strings inside roles and texts are escaped reversibly. ``segments`` concatenate to ``formatted``; those
    with ``loss`` are exactly the texts of the assistant.

    A long conversation is sorted and joined in groups of turn numbers first, so that what a single task gathers are
    few strings; the last step only puts groups in order.
    """
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    rows = turns.select("conv_id", F.floor(F.col("turn") / GROUP).alias("part"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    groups = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    groups = groups.select(
        "conv_id",
        F.struct("part", F.col("turns")[0]["role"].alias("first"), F.element_at("turns", -1)["role"].alias("last"), let(F.col("turns"), _within).alias("segments")).alias("g"),
    )
    whole = groups.groupBy("conv_id").agg(F.array_sort(F.collect_list("g"), lambda x, y: _order(x["part"], y["part"])).alias("groups"))
    whole = whole.select("conv_id", let(F.col("groups"), _across).alias("segments"))
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _order(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _open(role: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(SAYS))


def _join(before: Column, role: Column) -> Column:
    """What stands between two turns: only a mark if the role stays."""
    return F.when(before == role, F.lit(PART)).otherwise(F.concat(F.lit(END), _open(role)))


def _within(turns: Column) -> Column:
    """Segments of a sorted group of turns, without what precedes its first text."""

    def one(t: Column, i: Column) -> Column:
        said = _segment(t["text"], t["role"] == TRAINED)
        before = F.try_element_at(turns, F.greatest(i, F.lit(1)))["role"]
        return F.when(i == 0, F.array(said)).otherwise(F.array(_segment(_join(before, t["role"]), F.lit(False)), said))

    return F.flatten(F.transform(turns, one))


def _across(groups: Column) -> Column:
    """Segments of a conversation from those of its sorted groups."""

    def one(g: Column, i: Column) -> Column:
        before = F.try_element_at(groups, F.greatest(i, F.lit(1)))["last"]
        head = F.when(i == 0, _open(g["first"])).otherwise(_join(before, g["first"]))
        return F.concat(F.array(_segment(head, F.lit(False))), g["segments"])

    return F.concat(F.flatten(F.transform(groups, one)), F.array(_segment(F.lit(END), F.lit(False))))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), one for each turn, from a formatted conversation."""

    def block(b: Column) -> Column:
        role = unescape(F.substring(b[0], len(TURN) + 1, 1 << 30))
        return F.transform(F.split(b[1], _literal(PART)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, _literal(END)), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: block(F.split(b, _literal(SAYS)))))


def trained_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _literal(mark: str) -> str:
    return mark.replace("|", r"\|")
