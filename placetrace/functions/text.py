"""Text rules: cleaning, name keys, display names, lists, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetrace.params import DEFAULT, LIST_SEPARATOR, PUBLIC_RACK, Rules


def clean(value: Column) -> Column:
    """Collapse whitespace and trim; text without content becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def normalize_name(name: Column) -> Column:
    """Comparison key of a name: '' when missing, no case, no display suffix.

    ``(?U)`` makes ``\\s`` cover Unicode blanks such as the no-break space.
    """
    collapsed = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(F.lower(collapsed), r"\s*\((?:\*|temp)\)\s*$", ""))


def display_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i)\s*\((?:\*|temp)\)\s*$", ""))


def is_placeholder(name_key: Column) -> Column:
    """Names made only of digits and dots stand for an id, not a place."""
    return F.coalesce(name_key.rlike(r"(?U)^[\d.]+$"), F.lit(False))


def has_real_name(name_key: Column) -> Column:
    return (F.coalesce(name_key, F.lit("")) != "") & ~is_placeholder(name_key)


def split_list(joined: Column) -> Column:
    """The members of a `` | ``-joined list; empty for NULL or ''."""
    parts = F.split(F.coalesce(joined, F.lit("")), r" \| ")
    return F.filter(parts, lambda part: part != "")


def join_list(values: Column) -> Column:
    return F.array_join(values, LIST_SEPARATOR)


def sorted_list(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def name_class(name_key: Column) -> Column:
    return F.when(name_key.contains(PUBLIC_RACK), "public_rack").otherwise("station")


def is_operational(name_key: Column, ids: Column, rules: Rules = DEFAULT) -> Column:
    """``ids`` is an array of source ids; they count as further words."""
    words = F.concat(name_key, F.lit(" "), F.lower(F.array_join(ids, " ")))
    return words.rlike(rules.operational_regex)


def entity_class(name_key: Column, ids: Column, rules: Rules = DEFAULT) -> Column:
    return F.when(is_operational(name_key, ids, rules), "operational").otherwise(
        name_class(name_key)
    )


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
