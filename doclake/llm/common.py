"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.session import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once as Parquet to the folder all executors share, and read back.

    This cuts the lineage: a lost executor costs its own tasks, not the steps before.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_space(text: Column) -> Column:
    """The text without the six ASCII white-space characters [\\x20\\x09-\\x0D]; NULL counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def prefix_sums(steps: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of long values.

    Appending to an array copies it, so sums run inside blocks and over block totals: n * block copies, not n * n.
    """

    def running(values: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(
            values, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(block)).cast("int")),
        lambda i: running(F.slice(steps, i * block + 1, F.lit(block))),
    )

    def shifted(parts: Column) -> Column:
        totals = running(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
        return F.flatten(
            F.zip_with(parts, F.concat(F.array(F.lit(0).cast("bigint")), totals), _shift)
        )

    empty = F.array().cast("array<bigint>")
    # One-element arrays bind an expression to a lambda variable, so that it is computed once.
    bound = F.transform(F.array(blocks), shifted)
    return F.when(F.coalesce(F.size(steps), F.lit(0)) > 0, F.get(bound, F.lit(0))).otherwise(empty)


def _shift(part: Column, start: Column) -> Column:
    return F.transform(F.coalesce(part, F.array().cast("array<bigint>")), lambda v: v + start)


def numbered(values: Column) -> Column:
    """Indexes 0 .. size - 1 of an array; none for an empty or NULL one."""
    size = F.coalesce(F.size(values), F.lit(0))
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
