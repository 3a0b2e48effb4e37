"""Rule-driven Column expressions, and the same rules as DuckDB SQL for oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(subject: Column, rules: dict[str, list[str]], default: str | None) -> Column:
    """Label of the first rule with a pattern found in subject."""
    out = None
    for label, patterns in rules.items():
        cond = subject.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def labels_where(conditions: Iterable[tuple[str, Column]]) -> Column:
    """Array of the labels whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(label)) for label, c in conditions)), lambda x: x.isNotNull())


def contained(subject: Column, terms: Iterable[str]) -> Column:
    """Array of the terms that occur in subject."""
    return labels_where((t, F.contains(subject, F.lit(t))) for t in terms)


def count_contained(subject: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(subject, F.lit(t)).cast("int") for t in terms))


def any_contained(subject: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(subject, F.lit(t)) for t in terms))


def any_match(subject: Column, patterns: Iterable[str], flags: str = "") -> Column:
    return subject.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def argmax_label(counts: list[tuple[str, Column]], default: str) -> Column:
    """Label of the largest count, the first of equals; default if all are 0."""
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, (label, c) in enumerate(counts))))
    # counted once: the condition and its result would each do it
    return F.transform(F.array(best), lambda b: F.when(b["n"] == 0, F.lit(default)).otherwise(b["label"]))[0]


# The same in DuckDB SQL.


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def sql_first_match(subject: str, rules: dict[str, list[str]], default: str | None) -> str:
    cases = " ".join(f"when regexp_matches({subject}, {quoted('|'.join(f'(?:{p})' for p in patterns))}) then {quoted(label)}" for label, patterns in rules.items())
    return f"case {cases} else {quoted(default)} end"


def sql_labels(conditions: Iterable[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then {quoted(label)} end" for label, c in conditions) + "], lambda x: x is not null)"


def sql_contained(subject: str, terms: Iterable[str]) -> str:
    return sql_labels((t, f"contains({subject}, {quoted(t)})") for t in terms)


def sql_count(subject: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"cast(contains({subject}, {quoted(t)}) as int)" for t in terms) + ")"


def sql_any(subject: str, terms: Iterable[str]) -> str:
    return "(" + " or ".join(f"contains({subject}, {quoted(t)})" for t in terms) + ")"


def sql_match(subject: str, patterns: Iterable[str], flags: str = "") -> str:
    return f"regexp_matches({subject}, {quoted(flags + '|'.join(f'(?:{p})' for p in patterns))})"


class Registry:
    """Collects queries and their oracles."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return put
