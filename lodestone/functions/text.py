"""Column functions on text: tokens, identifier words, hashes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; a lower-case letter or digit before a capital ends a word."""
    cut = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda x: x != "")


def split_identifier(name: Column) -> Column:
    """Words of an identifier; a run of capitals before a capitalised word is one word."""
    return tokenize(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(file: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", file, start.cast("string"), end.cast("string"))), 1, 12)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a file name without a dot stands for itself."""
    name = F.element_at(F.split(path, "[/\\\\]"), -1)
    return F.lower(F.when(F.instr(name, ".") > 0, F.regexp_extract(name, "(\\.[^.]*)$", 1)).otherwise(name))


def estimated_tokens(file: Column, start: Column, end: Column, text: Column) -> Column:
    shown = F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), text)
    return F.ceil(F.octet_length(shown) / 4).cast("long")
