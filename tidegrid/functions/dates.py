"""Text dates in mixed formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegrid.functions.missing import as_col


def mixed_date_parts(text: Column | str) -> dict[str, Column]:
    """Year, month and day of ``m/d/yy`` or ``yyyy-mm-dd`` text in one pass.

    Two-digit years are taken as 20yy without a pivot.  Text in neither form gives NULLs.
    """
    text = as_col(text)
    slash = F.split(text, "/")
    dash = F.split(text, "-")
    is_slash = text.contains("/")
    is_dash = text.contains("-")

    def pick(slash_part: Column, dash_part: Column) -> Column:
        chosen = F.when(is_slash, slash_part).when(is_dash, dash_part)
        return chosen.try_cast("int")

    def part(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i))

    return {
        "year": pick(F.concat(F.lit("20"), part(slash, 2)), part(dash, 0)),
        "month": pick(part(slash, 0), part(dash, 1)),
        "day": pick(part(slash, 1), part(dash, 2)),
    }
