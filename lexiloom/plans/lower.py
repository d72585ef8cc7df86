"""Syntax trees as Column expressions over one grouped row for each document.

The row has ts (the query terms that the document holds) and pm (term -> positions,
for the terms of phrases). Every leaf is false, never null, where the row is missing,
so that NOT is right after an outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.plans.query import And, Node, Not, Or, Phrase, Term


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - F.lit(by))


def phrase_condition(terms: tuple[str, ...], positions) -> Column:
    """Whether some p has every term i at p + i; positions gives a term's positions as a Column.

    The list that is walked is the first term's; for each further term it is narrowed
    to the starts that still fit, by one array intersection.
    """
    starts = positions(terms[0])
    for i, term in enumerate(terms[1:], 1):
        starts = F.array_intersect(starts, _moved(positions(term), i))
    return F.size(starts) > 0


def predicate(node: Node, ts: Column, pm: Column) -> Column:
    match node:
        case Term(term):
            return _sure(F.array_contains(ts, term))
        case Phrase(()):
            return F.lit(False)
        case Phrase((term,)):
            return _sure(F.array_contains(ts, term))
        case Phrase(terms):
            return _sure(phrase_condition(terms, lambda t: F.try_element_at(pm, F.lit(t))))
        case Not(part):
            return ~predicate(part, ts, pm)
        case And(parts):
            return reduce(lambda a, b: a & b, [predicate(p, ts, pm) for p in parts])
        case Or(parts):
            return reduce(lambda a, b: a | b, [predicate(p, ts, pm) for p in parts])


def folded_score(cs: Column, terms: list[str] | None = None) -> Column:
    """The sum of the contributions (term, c) in term order, so that equal documents get equal doubles."""
    if terms is not None:
        wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
        cs = F.filter(cs, lambda x: F.array_contains(wanted, x["term"]))
    return F.coalesce(F.aggregate(F.sort_array(cs), F.lit(0.0), lambda s, x: s + x["c"]), F.lit(0.0))
