"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is an expression of built-in functions over the whole text; a rule names a metric and
the least and most it may be. No user function runs, and no rows are shuffled.

Defined results: a null text has no words; an empty or blank text has zero in every metric; a ratio
whose divisor is zero is zero; repeated rows each give their own row; an empty table gives an
empty table. Extra columns pass through unless they have the name of a metric, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, words_of

#: Frequent function words of the languages that the rules are meant for.
STOP_WORDS = (
    "the of and to in a is that for it was on are with as be at by this from or an have not "
    "der die das und in den von zu mit ist des im nicht ein eine sich auf für auch es "
    "le la les de des et en un une du que qui dans pour par sur au avec ne pas "
    "el los las y del se con una por para su al lo como más o no un es"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The thresholds of production. A document is kept if every metric lies within its bounds.
RULES = (
    Rule("enough_words", "n_words", least=50),
    Rule("few_repeats", "repeat_ratio", most=0.5),
    Rule("word_length", "mean_word_chars", least=2.0, most=20.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("letters", "letter_word_ratio", least=0.7),
    Rule("lines", "dup_line_ratio", most=0.5),
    Rule("bullets", "bullet_line_ratio", most=0.9),
    Rule("ellipses", "ellipsis_line_ratio", most=0.4),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def repeated_words(words: str, hashes: str) -> list[tuple[str, Column]]:
    """Steps that count the words within any 3-word window found twice or more; a step may use those before it.

    A window's hash loses its top bits to make room for its position, so that one sort of plain
    longs brings equal windows together; full hashes then confirm neighbours.
    """
    n, sorted_ = F.size(words), "_packed"
    shift = F.length(F.bin(F.size(words)))
    key = lambda p: F.call_function("shiftrightunsigned", p, F.col("_shift"))
    place = lambda p: p.bitwiseAND(_shl(F.lit(1).cast("long"), F.col("_shift")) - 1)
    full = lambda p: F.get(F.col(hashes), place(p).cast("int"))

    def same(p: Column, j: Column) -> Column:
        other = F.get(F.col(sorted_), j)
        return F.coalesce((key(other) == key(p)) & (full(other) == full(p)), F.lit(False))

    none = F.array().cast("array<bigint>")
    return [
        (hashes, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(none)),
        ("_shift", shift),
        (sorted_, F.sort_array(F.transform(hashes, lambda h, i: _shl(h, F.col("_shift")).bitwiseOR(i.cast("long"))))),
        ("_again", F.sort_array(F.transform(F.filter(sorted_, lambda p, j: same(p, j - 1) | same(p, j + 1)), place))),
        ("n_repeat_words", F.aggregate("_again", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")), lambda a: a["n"])),
    ]


def _shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every metric added."""
    line_words = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    many = lambda pred: F.size(F.filter("_lines", pred)).cast("long")
    n_lines = F.size("_lines").cast("long")
    df = docs.withColumns({"_text": text_of(text)}).withColumns({"_words": words_of(F.col("_text")), "_lines": line_words})
    for name, step in repeated_words("_words", "_hashes"):
        df = df.withColumn(name, step)
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (n_lines - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
            "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
            "n_lines": n_lines,
            "n_bullet_lines": many(lambda x: x.rlike(r"^\s*[-*•]")),
            "n_ellipsis_lines": many(lambda x: x.rlike(r"(\.\.\.|…)\s*$")),
        }
    )
    n = F.col("n_words")
    return df.withColumns(
        {
            "repeat_ratio": _ratio(F.col("n_repeat_words"), n),
            "mean_word_chars": _ratio(F.col("word_chars"), n),
            "symbol_ratio": _ratio(F.col("n_symbols"), n),
            "stop_ratio": _ratio(F.col("n_stop_words"), n),
            "letter_word_ratio": _ratio(F.col("n_letter_words"), n),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), F.col("n_lines")),
            "ellipsis_line_ratio": _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
        }
    ).drop("_text", "_words", "_lines", "_hashes", "_shift", "_packed", "_again")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression: true if every metric is within bounds."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.metric) >= F.lit(r.least))
        if r.most is not None:
            out = out & (F.col(r.metric) <= F.lit(r.most))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with all metrics, base_failed, failed_rules (names, in the table's order) and kept."""
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    broken = F.filter(F.array(*[F.when(~verdict((r,)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return measured(docs, text).withColumns({"base_failed": base, "failed_rules": broken}).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns, whatever their names.

    A plain filter on kept would be pushed below the projections, which copies every metric's expression
    into it, sorts and all, once for each element. The column filtered on here reads the number of the
    task too, which is never negative: such a filter stays above, and each metric is computed once.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return quality_rules(rows).select("row", F.when(F.spark_partition_id() >= 0, F.col("kept")).alias("keep")).where("keep").select("row.*")
