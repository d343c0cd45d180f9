"""Path spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    r"""One spelling per path: ``\`` becomes ``/``, empty and ``.`` steps vanish, ``..`` takes back a step.

    A ``..`` with nothing to take back is kept, so such a path equals no path inside the repository.
    Null stays null. Most paths are canonical already and take the short branch.
    """
    steps = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"\\|(^|/)\.{0,2}(/|$)"), F.array_join(walked, "/")).otherwise(path)
