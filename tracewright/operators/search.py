"""Whole-word text search: one row per line that holds the symbol."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import whole_word


def grep(lines: DataFrame, symbol: str) -> DataFrame:
    """(file, line) of the lines that hold the symbol as a whole word, once each."""
    return lines.where(whole_word(F.col("text"), symbol)).select("file", "line").distinct()


def grep_many(lines: DataFrame, symbols: list[str]) -> DataFrame:
    """(symbol, file, line) for many symbols in one pass: lines are cut into words, and words meet the symbols.

    Symbols that are no plain words are searched one by one.
    """
    plain = sorted({s for s in symbols if re.fullmatch(r"[A-Za-z0-9_]+", s)})
    odd = sorted({s for s in symbols if s and s not in plain})
    words = lines.select("file", "line", F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9_]+"))).alias("symbol"))
    table = lines.sparkSession.createDataFrame([(s,) for s in plain], "symbol string")
    out = words.join(table, "symbol", "left_semi").select("symbol", "file", "line")
    for s in odd:
        out = out.unionByName(grep(lines, s).select(F.lit(s).alias("symbol"), "file", "line"))
    return out.distinct()


def word_hits(docs: DataFrame, symbol: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line) of the lines of texts that hold the symbol; lines count from 1."""
    rows = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line_text"))
    return rows.where(whole_word(F.col("line_text"), symbol)).select(id_col, (F.col("pos") + 1).alias("line"))
