"""Routes: the first whose label and methods fit takes a request; middleware and handlers are DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Route:
    handler: Step
    label: str | None = None  # None fits every label
    methods: frozenset[str] = frozenset()  # empty fits every method

    def fits(self, label: Column, method: Column) -> Column:
        out = F.lit(True) if self.label is None else label.eqNullSafe(F.lit(self.label))
        return out & method.isin(*sorted(self.methods)) if self.methods else out

    def covers(self, other: Route) -> bool:
        return self.label in (None, other.label) and (not self.methods or bool(other.methods) and other.methods <= self.methods)


@dataclass
class Router:
    routes: list[Route] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    fallback: Step | None = None

    def route(self, handler: Step, label: str | None = None, *methods: str) -> Router:
        self.routes.append(Route(handler, label, frozenset(m.upper() for m in methods)))
        return self

    def default(self, handler: Step) -> Router:
        self.fallback = handler
        return self

    def middleware(self, step: Step) -> Router:
        self.steps.append(step)
        return self

    def shadowed(self) -> list[int]:
        """Routes that can never be reached, as an earlier one covers them."""
        return [i for i, r in enumerate(self.routes) if any(e.covers(r) for e in self.routes[:i])]

    def assign(self, requests: DataFrame) -> DataFrame:
        """requests with route: its number, -1 for the fallback, null where no route fits."""
        out = F.lit(-1 if self.fallback else None).cast("int")
        for i in reversed(range(len(self.routes))):
            out = F.when(self.routes[i].fits(F.col("label"), F.col("method")), i).otherwise(out)
        return requests.withColumn("route", out)

    def handle(self, requests: DataFrame) -> DataFrame:
        """Rows of all handlers, after the middleware; requests without route are left to `missing`."""
        routed = self.assign(reduce(lambda df, step: step(df), self.steps, requests))
        handlers = [*((i, r.handler) for i, r in enumerate(self.routes)), *([(-1, self.fallback)] if self.fallback else [])]
        parts = [h(routed.filter(F.col("route") == i)) for i, h in handlers]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def missing(self, requests: DataFrame) -> DataFrame:
        return self.assign(requests).filter("route IS NULL").withColumn("error_class", F.lit("missing_route"))
