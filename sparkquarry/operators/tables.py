"""Tables written as HTML or lists of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_rows(html: Column) -> Column:
    """The rows of the first table as arrays of cell texts; cells end at the next cell or the row's end."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)(?=<tr[ >]|</tr|</table|$)"), F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)(?=<t[dh][ >]|</t[dh]|$)"), F.lit(1)), clean))


def rectangular(rows: Column) -> Column:
    """The rows that have as many cells as the first."""
    return F.filter(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))


def row_records(tables: DataFrame, key: str, rows: str) -> DataFrame:
    """``key, row_index, cells, fields``: each row under the first as cells and, where it fits the header, as fields by header."""
    t = tables.select(key, F.get(rows, F.lit(0)).alias("header"), F.posexplode(rows).alias("pos", "cells")).where("pos > 0")
    fits = (F.size("cells") == F.size("header")) & (F.size(F.array_distinct("header")) == F.size("header"))
    return t.select(key, (F.col("pos") - 1).alias("row_index"), "cells", F.when(fits, F.map_from_arrays("header", "cells")).alias("fields"), fits.alias("validated"))


def render_markdown(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit(" "))), " | "), F.lit(" |"))
    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(head)))
    return F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def parent_index(parents: DataFrame, sidecar: DataFrame, key: str = "table_id") -> DataFrame:
    """Tables found in texts, and those of the sidecar whose ``key`` isn't among them; columns that one lacks are null there. Null keys of the sidecar are all kept."""
    return parents.unionByName(sidecar.join(parents.select(key), key, "left_anti"), allowMissingColumns=True)


def table_type(header: Column, body: Column, types: list[tuple[str, list[str]]], in_header: int = 1, in_body: int = 3) -> Column:
    """The first of the configured types (name, words) whose words occur ``in_header`` times in a table's header, else ``in_body`` times in header and body; else ``unknown``. Case, spaces and punctuation don't matter; null texts are empty."""
    compact = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    def hits(text: Column, words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + (F.char_length(text) - F.char_length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
        return total

    head, whole = compact(header), F.concat(compact(header), compact(body))
    out = F.lit("unknown")
    for name, words in reversed(types):
        out = F.when(hits(whole, words) >= in_body, name).otherwise(out)
    for name, words in reversed(types):
        out = F.when(hits(head, words) >= in_header, name).otherwise(out)
    return out


def asked_type(query: Column, types: list[tuple[str, list[str]]]) -> Column:
    """The first configured type that a question has a word of; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(types):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(F.lower(query), F.lit(w))
        out = F.when(has, name).otherwise(out)
    return out
