"""Column expressions for the scalar idioms of functional data programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.columns import as_column


def truthy(value: Column | str) -> Column:
    """Whether a number is neither null, NaN nor zero."""
    c = as_column(value)
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


def words(text: Column | str, separator: str = " ") -> Column:
    """Pieces of a text between a literal separator."""
    if len(separator) == 1:  # the splitter's own fast path takes one character, bare or escaped
        pattern = separator if separator.isalnum() or separator.isspace() or ord(separator) > 127 else f"\\{separator}"
    else:
        pattern = rf"\Q{separator}\E"
    return F.split(as_column(text), pattern)


def trimmed(pieces: Column | str) -> Column:
    return F.transform(as_column(pieces), lambda x: F.trim(x))


def number(text: Column | str) -> Column:
    """The text as a double; null where it is none."""
    return as_column(text).try_cast("double")


def index_of(value: Column | str, choices: Sequence) -> Column:
    """Place of a value in a list of choices from 0; -1 where it is not there."""
    at = F.array_position(F.array(*[F.lit(x) for x in choices]), as_column(value))
    return F.coalesce(at.cast("int"), F.lit(0)) - 1


def one_of(value: Column | str, choices: Sequence) -> Column:
    return as_column(value).isin(list(choices))


def starts_with(text: Column | str, prefix: str) -> Column:
    return as_column(text).startswith(prefix)


def after_last(token: Column | str, separator: str = ":") -> Column:
    """What follows the last separator of a token such as ``index:value``."""
    return F.split_part(as_column(token), F.lit(separator), F.lit(-1))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products of two arrays; a null counts as zero."""
    product = F.zip_with(as_column(a), as_column(b), lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-as_column(x)))


def to_json(value: Column | str) -> Column:
    """JSON text that keeps null fields; works for scalars as well."""
    return F.regexp_extract(F.to_json(F.struct(as_column(value).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)


def parse_json(text: Column | str, schema: str) -> Column:
    return F.from_json(as_column(text), schema)
