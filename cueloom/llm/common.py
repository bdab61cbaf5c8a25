"""Helpers that several operators of this subpackage share, among them the library's ranks and scratch
tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.operators.ranks import ranked
from cueloom.sources.scratch import materialize, scratch_dir, scratch_path, spread

__all__ = ["WORD_SPACE", "let", "lower_ascii", "materialize", "quoted", "ranked", "replace_columns", "scratch_dir", "scratch_path", "spread"]

#: What bytes.split() and the contracts' word pattern take as space: \x20 and \x09 to \x0D.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add ``new``; an input column of the same name gives way (names compare without case)."""
    taken = {n.lower() for n in new}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken], *[c.alias(n) for n, c in new.items()])


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case and nothing else, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for the row, however often it is used, also
    inside a higher-order function of the body."""
    return F.element_at(F.transform(F.array(value), body), 1)
