"""Readings of hand-written times and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^[0-9]+(:[0-9]+){1,2}$"
MINUTES = r"^\s*([0-9]+)分(?:([0-9]+)秒?)?\s*$"
SECONDS = r"^\s*([0-9]+)秒\s*$"


def seconds(text: Column, strict: bool = True) -> Column:
    """Seconds of `H:MM:SS`, `M:SS` (any run of `:` and `;` separates), `N分M秒`, `N分M`, `N分` or `N秒`; anything else is an error, or null if not strict."""
    t = F.regexp_replace(F.trim(text), "[:;]+", ":")
    clock = F.aggregate(F.transform(F.split(t, ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda total, p: total * 60 + p)
    minutes = F.regexp_extract(t, MINUTES, 1).try_cast("double") * 60 + F.coalesce(F.regexp_extract(t, MINUTES, 2).try_cast("double"), F.lit(0.0))
    known = F.when(t.rlike(CLOCK), clock).when(t.rlike(MINUTES), minutes).when(t.rlike(SECONDS), F.regexp_extract(t, SECONDS, 1).try_cast("double"))
    if not strict:
        return known
    return known.otherwise(F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("double")))


def participant_id(raw: Column) -> Column:
    """An id trimmed, without the `.0` of a number, with `_` for `-`, and filled with zeros to six digits if it is a number."""
    s = F.replace(F.regexp_replace(F.trim(raw.cast("string")), r"^([0-9]+)\.0$", "$1"), F.lit("-"), F.lit("_"))
    return F.when(s.rlike("^[0-9]+$") & (F.char_length(s) < 6), F.lpad(s, 6, "0")).otherwise(s)
