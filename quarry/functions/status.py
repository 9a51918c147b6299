"""Status and content-type functions on columns, and the status option."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import ConfigError


def status_class(status: Column) -> Column:
    """The colour class of a status; what is no number stays as it is."""
    n = F.try_cast(status, "int") if hasattr(F, "try_cast") else status.try_cast("int")
    return (
        F.when(n.isNull(), status)
        .when(n == 200, "green")
        .when((n >= 300) & (n < 400), "yellow")
        .when((n >= 400) & (n < 500), "magenta")
        .otherwise("red")
    )


def status_allowed(status: Column, ranges: list[tuple[int, int]] | None) -> Column:
    """Whether a status is shown: never 404; without ranges everything else; with ranges only numbers in one of [start, end)."""
    n = status.try_cast("int")
    if ranges is None:
        return F.coalesce(n != 404, F.lit(True))
    inside = reduce(lambda a, r: a | ((n >= r[0]) & (n < r[1])), ranges, F.lit(False))
    return F.coalesce((n != 404) & inside, F.lit(False))


def unknown_status(status: Column) -> Column:
    """Whether a status is not all digits."""
    return ~F.coalesce(status, F.lit("")).rlike(r"^[0-9]+\z")


def parse_status(option: str) -> list[tuple[int, int]]:
    """`200,300-400` as half-open ranges. Ends of a range are compared as text, as users of the option know it."""
    out = []
    for part in option.split(","):
        low, dash, high = part.strip().partition("-")
        try:
            if dash and low >= high:
                raise ConfigError(f"not a status range: {part!r}")
            out.append((int(low), int(high) + 1 if dash else int(low) + 1))
        except ValueError as error:
            raise ConfigError(f"not a status: {part!r}") from error
    return out


def links_wanted(content_type: Column) -> Column:
    """Whether links are looked for in a response of this content type: text/*, and application/* but octet-stream and pdf."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return F.startswith(kind, F.lit("text/")) | (F.startswith(kind, F.lit("application/")) & ~kind.isin("application/octet-stream", "application/pdf"))
