"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_dir, shared_path, written

__all__ = ["LOWER", "SPACES", "UPPER", "ascii_lower", "fresh_name", "shared_dir", "shared_path", "whole_text", "words_of", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that parts words: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: str = "text") -> Column:
    """The text of a document, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
