"""Helpers that write Spark SQL expression text over arrays and fixed word lists.

Lists with hundreds of words are far cheaper to hand to Spark as one parsed expression than
as hundreds of Column objects, so the operators are written as SQL text throughout. ``IN``
over literals becomes a hash set in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quote(value: str) -> str:
    """A string literal; raw, so patterns keep their backslashes."""
    mark = '"' if "'" in value else "'"
    assert mark not in value, value
    return f"r{mark}{value}{mark}"


def listing(values: Iterable[str]) -> str:
    return ", ".join(quote(v) for v in dict.fromkeys(values))


def words(values: Iterable[str]) -> str:
    """A fixed word list as an array literal."""
    return f"array({listing(values)})"


def within(value: str, values: Iterable[str]) -> str:
    """Membership in a fixed word list."""
    return f"{value} IN ({listing(values)})"


def mapping(table: Mapping[str, str]) -> str:
    """A fixed lookup table as a map literal."""
    return f"map({', '.join(f'{quote(k)}, {quote(v)}' for k, v in table.items())})"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once under a name.

    Inside a lambda Catalyst does not share common sub-expressions, so a one-element
    ``transform`` is the binding.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def any_in(array: str, values: Iterable[str]) -> str:
    return f"exists({array}, x -> {within('x', values)})"


def common(array: str, values: Iterable[str]) -> str:
    """The distinct elements of the array that are in the list.

    ``array_intersect`` would build a hash set of the whole list for each row; the one behind ``IN`` is built once.
    """
    return f"array_distinct(filter({array}, x -> {within('x', values)}))"


def n_common(array: str, values: Iterable[str]) -> str:
    return f"size({common(array, values)})"


def joined(array: str) -> str:
    """An array as one comma-separated string, sorted."""
    return f"array_join(array_sort(array_distinct({array})), ',')"


def same_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which a null key is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, met, how).drop(*[f"_r_{k}" for k in keys])


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns here, once.

    A filter on a derived column is pushed down by writing the column's whole expression into it,
    and for a long chain of columns that means computing everything many times over. A
    one-element explode is a narrow operator such a filter does not move across.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")
