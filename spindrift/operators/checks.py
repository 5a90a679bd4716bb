"""Checks of evaluation runs by name: functions over tables, registered once, and run as a suite."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from spindrift.operators import evidence

#: (cases, runs, events, measured, by) to verdicts.
Check = Callable[[DataFrame, DataFrame, DataFrame, DataFrame, tuple[str, ...]], DataFrame]


class Checks:
    """A registry. A name is taken once; asking for one that is not there is an error that names those there are."""

    def __init__(self) -> None:
        self._of: dict[str, Check] = {}

    def check(self, name: str) -> Callable[[Check], Check]:
        def add(f: Check) -> Check:
            if name in self._of:
                raise ValueError(f"check {name!r} is there already")
            self._of[name] = f
            return f

        return add

    def names(self) -> list[str]:
        return sorted(self._of)

    def get(self, name: str) -> Check:
        if name not in self._of:
            raise KeyError(f"no check {name!r}; there are {', '.join(self.names()) or 'none'}")
        return self._of[name]

    def chosen(self, asked: list[str] | None = None, configured: list[str] | None = None) -> list[str]:
        """The names asked for, else the configured ones, else all, each once in first-seen order; unknown ones are an error before anything runs."""
        names = list(dict.fromkeys(asked or configured or self.names()))
        unknown = [n for n in names if n not in self._of]
        if unknown:
            raise KeyError(f"unknown checks {', '.join(unknown)}; there are {', '.join(self.names()) or 'none'}")
        return names

    def run(self, cases: DataFrame, runs: DataFrame, events: DataFrame, measured: DataFrame, names: list[str] | None = None, by: tuple[str, ...] = evidence.RUN) -> DataFrame:
        """The verdicts of the chosen checks as one table."""
        parts = [self.get(n)(cases, runs, events, measured, by) for n in self.chosen(names)]
        return reduce(lambda a, b: a.unionByName(b), parts)


def built_in() -> Checks:
    """A registry of the seven built-in checks, to which a caller can add."""
    c = Checks()
    c.check("repeated_calls")(lambda cases, runs, events, measured, by: evidence.repeated_calls(runs, events, by))
    c.check("faithfulness")(lambda cases, runs, events, measured, by: evidence.faithfulness(runs, events, by))
    c.check("latency_cost")(lambda cases, runs, events, measured, by: evidence.latency_cost(cases, measured, by))
    for f in (evidence.coverage, evidence.entity_resolution, evidence.expected_clarification, evidence.forbidden_phrases):
        c.check(f.__name__)(lambda cases, runs, events, measured, by, f=f: f(cases, runs, events, by))
    return c
