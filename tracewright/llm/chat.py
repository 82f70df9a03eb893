"""Chat formatting: a finite-state machine over roles, and a declarative template.

The template gives, for each role, the strings before and after a text and whether the text bears
loss, and the transitions that a well-formed conversation may take. Turns become segments
(text, loss) whose concatenation is the formatted conversation. Control strings inside texts and
role names are escaped, and the escape is undone without loss when the output is read back.

Defined results: a null text or role is empty; an unknown role takes the default markup and bears
no loss; turns sort by turn (null first), then role, then text, so repeated rows stay, next to each other;
a conversation of null id is a conversation of its own; a wrong turn order is flagged (valid, bad_turns), not
dropped. Columns other than conv_id, turn, role and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: {role} stands for the escaped role. Every turn is opening, text, closing.
    opening: str = "<s>[{role}]\n"
    closing: str = "</s>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that must not occur in a text: the template's own, and those of kindred templates.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    #: (state, role, next state). A conversation is valid if it goes from `start` to an accepting state.
    transitions: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepting: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    """& becomes &amp; and then each control string &c<number>;. No control string is left, as none holds an &."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for i, c in enumerate(t.controls):
        out = F.replace(out, F.lit(c), F.lit(f"&c{i};"))
    return out


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    out = text
    for i, c in reversed(list(enumerate(t.controls))):
        out = F.replace(out, F.lit(f"&c{i};"), F.lit(c))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column, t: Template = TEMPLATE) -> Column:
    return F.replace(F.replace(escape(role, t), F.lit("]"), F.lit("&b;")), F.lit("\n"), F.lit("&n;"))


def unescape_role(role: Column, t: Template = TEMPLATE) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("&n;"), F.lit("\n")), F.lit("&b;"), F.lit("]")), t)


def _step(state: Column, role: Column, t: Template) -> Column:
    out = F.lit("bad")
    for was, r, now in t.transitions:
        out = F.when((state == was) & (role == r), F.lit(now)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, bad_turns, segments (array of text, loss), formatted.

    Turns are escaped before they are gathered. After a wrong turn the machine starts again from
    that turn's role, so bad_turns counts the breaks of order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    convs = rows.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    first = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("bad"))

    def fold(a: Column, x: Column) -> Column:
        now = _step(a["state"], x["role"], t)
        return F.struct(F.when(now == "bad", x["role"]).otherwise(now).alias("state"), (a["bad"] + (now == "bad").cast("long")).alias("bad"))

    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    head, tail = t.opening.split("{role}")
    parts = F.flatten(
        F.transform(
            "_turns",
            lambda x: F.array(
                segment(F.concat(F.lit(head), escape_role(x["role"], t), F.lit(tail)), F.lit(False)),
                segment(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.closing), F.lit(False)),
            ),
        )
    )
    end = F.aggregate("_turns", first, fold)
    df = convs.withColumns({"_end": end, "segments": parts})
    return df.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        ((F.col("_end.bad") == 0) & F.col("_end.state").isin(*t.accepting)).alias("valid"),
        F.col("_end.bad").alias("bad_turns"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """From format_conversations' output alone: formatted with turns (array of role, text), unescaped, added.

    A closing mark cannot occur inside an escaped text or role, nor can the opening's end inside a role.
    """
    head, tail = t.opening.split("{role}")
    raw = F.slice(F.split("formatted", F.lit("\\Q" + t.closing + "\\E"), -1), 1, F.greatest(F.size(F.split("formatted", F.lit("\\Q" + t.closing + "\\E"), -1)) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        inner = F.substring(x, F.lit(len(head) + 1), F.length(x))
        at = F.instr(inner, F.lit(tail))
        role = F.substring(inner, F.lit(1), at - 1)
        return F.struct(unescape_role(role, t).alias("role"), unescape(F.substring(inner, at + len(tail), F.length(x)), t).alias("text"))

    return formatted.withColumn("_raw", raw).withColumn("turns", F.transform("_raw", turn)).drop("_raw")


def digest(formatted: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """The columns by which a formatted conversation is checked, all read back from the output."""
    back = read_back(formatted, t).withColumn("_loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), ""))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turns",
    )


def fixture(spark) -> DataFrame:
    """Conversation -7: texts full of control strings."""
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
