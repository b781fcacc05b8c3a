"""Conversations as one marked-up text each, in DataFrame expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent turns of one
role become one block by array functions; blocks are joined to a text:

    ### role:
    text</turn>
    ### role:
    text<more/>text</turn>

Texts and roles are escaped, so that none of the marks, and no line end within a role,
occurs in them; `read_back` inverts the format. `loss_runs` is a run-length mask over the
code points of the text, a pair for every turn: `skip` characters without loss, then `take`
characters with loss (0 but for the roles that are learned). What follows the last pair is
without loss.

Defined results: a null text or role counts as empty; turns are sorted by number, nulls first,
then role and text, so equal numbers and repeated rows each stay, in a fixed order; rows
without a conversation id form one conversation; an empty table gives no rows; other columns are
ignored. A conversation is one row of the result, and must fit one, as very long texts must:
nothing is cut.

Every step is linear in the conversation: blocks are slices between the places at which the role
changes, so that no array grows turn by turn. Turns are shuffled once, by conversation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, MORE, END = "### ", ":\n", "<more/>", "</turn>\n"
#: What texts must not hold, and what stands for it; the backslash comes first, and last when read.
ESCAPES = (("\\", "\\\\"), ("</turn>", "\\e"), ("<more/>", "\\m"), ("### ", "\\h"))
#: The end of a role is ":" and a line end: a line end within one is escaped as well.
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def escaped(text: Column, escapes: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), escapes, text)


def unescaped(text: Column, escapes: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    """The text again. Pairs of backslashes are set apart first: what is left of them is one of the marks."""
    parts = F.split(text, r"\\\\", -1)
    plain = lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), escapes[1:], c)
    return F.array_join(F.transform(parts, plain), "\\")


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: `id_col`, `formatted` (string), `loss_runs` (array of `skip` and `take`)."""
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = turns.select(F.col(quoted(id_col)).alias("id"), F.struct(F.col(quoted(turn_col)).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("said"))
    held = rows.groupBy("id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # the places at which another role begins, and the number of turns behind the last
    size = F.size("said")
    first = lambda i: (i == 0) | (F.get("said", i)["role"] != F.get("said", i - 1)["role"])
    held = held.withColumn("starts", F.concat(F.filter(F.sequence(F.lit(0), size - 1), first), F.array(size)))
    start, n_blocks = lambda k: F.get("starts", k), F.size("starts") - 1
    block = lambda k: F.struct(
        F.get("said", start(k))["role"].alias("role"), F.transform(F.slice("said", start(k) + 1, start(k + 1) - start(k)), lambda t: escaped(t["text"])).alias("texts")
    )
    merged = held.select("id", F.transform(F.sequence(F.lit(0), n_blocks - 1), block).alias("blocks"))
    head = lambda b: F.concat(F.lit(HEAD), escaped(b["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
    body = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], MORE), F.lit(END))), "")

    def runs(b: Column, k: Column) -> Column:
        """Of each text of a block: the template before it, and itself with or without loss."""
        before = F.length(head(b)) + F.when(k > 0, len(END)).otherwise(0)

        def run(t: Column, i: Column) -> Column:
            template = F.when(i > 0, len(MORE)).otherwise(before)
            taken = b["role"].isin(*learned)
            return F.struct((template + F.when(taken, 0).otherwise(F.length(t))).cast("long").alias("skip"), F.when(taken, F.length(t)).otherwise(0).cast("long").alias("take"))

        return F.transform(b["texts"], run)

    return merged.select(F.col("id").alias(id_col), body.alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("loss_runs"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds `turns` (array of role and text, one for each row that was formatted) and `learned`
    (array of the texts under the loss mask), both read from `formatted` and `loss_runs` alone."""
    blocks = F.split("formatted", END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing stands behind the last mark
    cut = chats.withColumn("read blocks", blocks)

    def texts(b: Column) -> Column:
        """The escaped texts of a block, with its role."""
        at = F.instr(b, AFTER_ROLE)
        role = F.substring(b, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        body = F.substring(b, at + len(AFTER_ROLE), F.length(b))
        return F.transform(F.split(body, MORE, -1), lambda t: F.struct(role.alias("role"), t.alias("text")))

    read = cut.withColumn("read turns", F.flatten(F.transform("read blocks", texts))).drop("read blocks")
    turns = F.transform("read turns", lambda t: F.struct(unescaped(t["role"], ROLE_ESCAPES).alias("role"), unescaped(t["text"]).alias("text")))
    # a pair of the mask ends where its text ends: the last `take` characters of it are under loss
    under = F.zip_with("read turns", "loss_runs", lambda t, r: F.when(r["take"] > 0, F.substring(t["text"], F.length(t["text"]) - r["take"].cast("int") + 1, r["take"].cast("int"))))
    return read.withColumns({"turns": turns, "learned": F.transform(F.filter(under, lambda t: t.isNotNull()), lambda t: unescaped(t))}).drop("read turns")
