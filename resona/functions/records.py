"""Expressions that render, name and route records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based UUID of a string in the DNS namespace; strings that are UUIDs stay."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lower(name)).otherwise(made)


def markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; nulls are empty and line breaks are spaces."""
    cell = lambda c: F.translate(F.coalesce(c, F.lit("")), "\n", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def stars(score: Column) -> Column:
    """Five buckets: above .8, .6, .4, 0 and the rest."""
    return F.when(score >= 0.8, 5).when(score >= 0.6, 4).when(score >= 0.4, 3).when(score > 0, 2).otherwise(1)


def input_route(has_signal: Column, query: Column) -> Column:
    asked = F.trim(F.coalesce(query, F.lit(""))) != ""
    return F.when(has_signal & asked, "hybrid").when(has_signal, "signal_only").when(asked, "rag_only").otherwise("error")


def machine_route(machine: Column) -> Column:
    return F.when(F.lower(F.coalesce(machine, F.lit(""))).rlike("reciprocating|piston"), "reciprocating").otherwise("rotating")


def harmonics(base: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: base * k)


def order_number(label: Column) -> Column:
    """'0.5X' as 0.5; null for others."""
    return F.nullif(F.regexp_extract(label, r"^(\d+(?:\.\d+)?)[xX]$", 1), F.lit("")).cast("double")


def first_json(text: Column) -> Column:
    """The object of a model's answer, code fences and text around it dropped, as VARIANT; null if it isn't JSON."""
    return F.try_parse_json(F.regexp_extract(F.regexp_replace(text, "```(json)?", ""), r"(?s)(\{.*\})", 1))


def embedding_text(section: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", section, text)


def parent_id(parent: Column, chunk_id: Column) -> Column:
    """The parent that is stated, else the part of a chunk's id before '_child_'."""
    return F.coalesce(parent, F.split_part(chunk_id, F.lit("_child_"), F.lit(1)))
