"""Per-row ranking of a probability array. One array sort per row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_col, percent


def names_array(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def known(proba: Column | str) -> Column:
    """The array with NaN turned into NULL, so that both rank below every number."""
    return F.transform(as_col(proba), lambda x: F.when(~F.isnan(x), x))


def argmax_index(proba: Column | str) -> Column:
    """0-based index of the largest entry; the lowest index wins a tie, NULL without one."""
    p = known(proba)
    place = F.array_position(p, F.array_max(p))
    return F.when(place > 0, place - 1).cast("int")


def max_confidence(proba: Column | str) -> Column:
    return F.array_max(known(proba))


def decode(index: Column | str, names: Sequence[str]) -> Column:
    """Name of a class number; NULL and numbers outside the list have none."""
    i = as_col(index).cast("int")
    return F.when(i.between(0, len(names) - 1), F.element_at(names_array(names), F.coalesce(i, F.lit(0)) + 1))


def ranked(proba: Column | str, names: Sequence[str]) -> Column:
    """array<struct<p, minus, name>> sorted by p descending, lower index first on ties.

    Gaps come last and have no name; a NULL array has no entries.
    """
    labels = names_array(names)

    def entry(x: Column, i: Column) -> Column:
        return F.struct(x.alias("p"), (-i).alias("minus"), F.when(x.isNotNull(), F.element_at(labels, i + 1)).alias("name"))

    return F.sort_array(F.transform(known(proba), entry), asc=False)


def top_string(ranked_entries: Column | str, k: int = 3) -> Column:
    """``name (pp.p%)`` of the first k entries, comma separated; gaps are left out."""
    entries = as_col(ranked_entries)
    parts = []
    for i in range(k):
        e = F.get(entries, F.lit(i))
        parts.append(F.concat(e["name"], F.lit(" ("), percent(e["p"]), F.lit(")")))
    return F.concat_ws(", ", *parts)


def named_probabilities(proba: Column | str, names: Sequence[str]) -> Column:
    return F.map_from_arrays(names_array(names), as_col(proba))
