"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one string of marked turns, ``<|im_start|>role`` newline text
``<|im_end|>`` newline. Every assistant turn is one training example: what stands before its text
is the context, its text alone is trained on. ``&`` and ``<|`` inside texts and roles (and line
ends in roles) are escaped, so no text can forge a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, targets.

    ``targets`` is an array of (example_no, loss_start, loss_end): the code points of ``formatted``
    that each assistant turn trains, in order. Null texts and roles count as empty; turns are
    ordered by turn, role and text, nulls first, so ties have one order and repeated rows stay.
    Rows with a null conversation id form one conversation. Other columns are ignored; an empty
    table gives an empty one. A conversation is one row of the output and so must fit in one.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.select(
        "conv_id",
        "role",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.length("body").alias("len"),
        F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("pos"),
        F.sum(F.length("head") + F.length("body") + F.lit(len(END))).over(w).alias("stop"),
    )
    end = F.col("stop") - F.lit(len(END))
    target = F.when(F.col("role") == "assistant", F.struct("pos", (end - F.col("len")).alias("loss_start"), end.alias("loss_end")))
    g = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(target)).alias("spans"),
        F.count("*").alias("n_turns"),
    )
    return g.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        "n_turns",
        F.transform("spans", lambda s, i: F.struct(i.alias("example_no"), s["loss_start"].alias("loss_start"), s["loss_end"].alias("loss_end"))).alias("targets"),
    )


def prefix_target_examples(formatted: DataFrame, with_context: bool = True) -> DataFrame:
    """One row per assistant turn: conv_id, example_no, loss_start, loss_end, target, and context.

    ``context`` is everything before the trained text, so ``context || target`` is the example and
    only code points from ``loss_start`` to ``loss_end`` carry loss. Contexts repeat the turns
    before them; leave them out (``with_context=False``) where the spans will do. Conversations
    without assistant turns give no row.
    """
    x = formatted.select("conv_id", "formatted", F.explode("targets").alias("t")).select("conv_id", "formatted", "t.*")
    span = F.substr("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    cols = ["conv_id", "example_no", "loss_start", "loss_end", span.alias("target")]
    if with_context:
        cols.append(F.substr("formatted", F.lit(1), F.col("loss_start").cast("int")).alias("context"))
    return x.select(*cols)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, "\n", 1), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, digests of what can be read back from the formatted text and its examples.

    The loss text is read from whole examples: all preceding turns as context, then the reply; what
    follows the context is trained.
    """
    f = format_conversations(turns)
    examples = prefix_target_examples(f).select("conv_id", "example_no", F.length("context").alias("prefix"), F.concat("context", "target").alias("example"))
    reply = unescape(F.substr("example", F.col("prefix") + 1))
    loss = examples.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example_no", reply.alias("t")))).alias("x"))
    loss = loss.select(F.col("conv_id").alias("c"), F.array_join(F.transform("x", lambda s: s["t"]), "").alias("loss"))
    back = f.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    text = F.coalesce("loss", F.lit(""))
    return back.join(loss, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
