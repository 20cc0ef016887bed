"""The aggregate functions as Spark aggregates. ``order`` numbers the lines where the result depends on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.scalars import Typed
from logloom.plans.errors import BindError
from logloom.plans.types import BOOLEAN, INT, INTERVAL, NULL, REAL, TEXT, array_of

#: name -> how many arguments
AGGREGATES = {"count": (0, 1), "min": (1,), "max": (1,), "sum": (1,), "avg": (1,), "stddev": (1,), "variance": (1,), "percentile": (2,), "bool_and": (1,), "bool_or": (1,), "array_agg": (1,), "string_agg": (2,)}
#: Those whose result depends on the order of the lines.
ORDERED = frozenset({"array_agg", "string_agg"})


def build(name: str, args: list[Typed], distinct: bool, order: Callable[[], Column]) -> Typed:
    """The aggregate of the arguments; ``args`` is empty for COUNT() and COUNT(*)."""
    if len(args) not in AGGREGATES[name]:
        raise BindError(f"{name} takes {' or '.join(map(str, AGGREGATES[name]))} arguments, not {len(args)}")
    if distinct and (name != "count" or not args):
        raise BindError(f"DISTINCT can't stand in {name} here")
    if name == "count":
        if not args:
            return Typed(F.count(F.lit(1)), INT)
        return Typed(F.count_distinct(args[0].column) if distinct else F.count(args[0].column), INT)
    x, kind = args[0].column, args[0].type
    if name in ("min", "max"):
        return Typed((F.min if name == "min" else F.max)(x), kind)
    if name == "sum":
        _check(name, args[0], INT, REAL, INTERVAL)
        return Typed(F.sum(x), kind)
    if name == "avg":
        _check(name, args[0], INT, REAL, INTERVAL)
        if kind == INT:  # the whole part of the mean
            return Typed(F.when(F.count(x) > 0, F.call_function("div", F.sum(x), F.greatest(F.count(x), F.lit(1)))), INT)
        return Typed(F.avg(x), kind)
    if name in ("stddev", "variance"):
        _check(name, args[0], INT, REAL)
        return Typed((F.stddev_pop if name == "stddev" else F.var_pop)(args[0].to(REAL)), REAL)
    if name == "percentile":
        # Over followed files only: the planner works out others from counts.
        p = percentile_share(args)
        # The value at the place floor(p * n) of the sorted values, the last one for p = 1.
        place = F.least(F.floor(F.count(x) * F.lit(p)), F.count(x) - 1)
        return Typed(F.get(F.sort_array(F.collect_list(x)), place.cast("int")), kind)
    if name in ("bool_and", "bool_or"):
        _check(name, args[0], BOOLEAN)
        return Typed((F.bool_and if name == "bool_and" else F.bool_or)(args[0].to(BOOLEAN)), BOOLEAN)
    if name == "array_agg":
        if kind == NULL:
            raise BindError("array_agg needs values with a type")
        pairs = F.array_sort(F.collect_list(F.struct(order().alias("o"), x.alias("x"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
        return Typed(F.transform(pairs, lambda z: z["x"]), array_of(kind))
    delimiter = args[1].literal
    if not isinstance(delimiter, str):
        raise BindError("string_agg takes a text as its second argument")
    _check(name, args[0], TEXT)
    text = args[0].to(TEXT)
    kept = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order().alias("o"), text.alias("x")))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return Typed(F.when(F.count(text) > 0, F.array_join(F.transform(kept, lambda z: z["x"]), delimiter)), TEXT)


def percentile_share(args: list[Typed]) -> float:
    """The second argument of a percentile, between 0 and 1."""
    if len(args) != 2:
        raise BindError(f"percentile takes 2 arguments, not {len(args)}")
    p = args[1].literal
    if not isinstance(p, float | int) or isinstance(p, bool):
        raise BindError("percentile takes a number between 0.0 and 1.0 as its second argument")
    return min(max(float(p), 0.0), 1.0)


def _check(name: str, arg: Typed, *allowed) -> None:
    if arg.type not in allowed and arg.type != NULL:
        raise BindError(f"{name} takes {', '.join(map(str, allowed))}, not {arg.type}")
