"""The query language: lexer, recursive-descent parser, syntax tree. No Spark here.

    query := or ;  or := and ("OR" and)* ;  and := not (["AND"] not)* ;  not := "NOT" not | atom
    atom  := "(" or ")" | word | '"' words '"'

Operators are whole words in any case. A word with punctuation inside becomes a
phrase, one without letters and digits vanishes. A quote that is never closed runs to
the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from lexiloom.functions.text import words


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    part: Node


Node = Term | Phrase | And | Or | Not

_BLANK = " \t\n\v\f\r"
_SPECIAL = _BLANK + '()"'
_FOLD = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lex(query: str) -> Iterator[tuple[str, Node | None]]:
    """(kind, leaf): kinds are AND OR NOT ( ) and leaf."""
    at = 0
    while at < len(query):
        c = query[at]
        if c in _BLANK:
            at += 1
        elif c in "()":
            yield c, None
            at += 1
        elif c == '"':
            stop = query.find('"', at + 1)
            stop = len(query) if stop < 0 else stop
            yield "leaf", Phrase(tuple(words(query[at + 1 : stop])))
            at = stop + 1
        else:
            start = at
            while at < len(query) and query[at] not in _SPECIAL:
                at += 1
            word = query[start:at]
            if word.translate(_FOLD) in ("AND", "OR", "NOT"):
                yield word.translate(_FOLD), None
            elif found := words(word):
                yield "leaf", Term(found[0]) if len(found) == 1 else Phrase(tuple(found))


class _Reader:
    def __init__(self, query: str):
        self.items = [*lex(query), ("end", None)]
        self.at = 0

    @property
    def kind(self) -> str:
        return self.items[self.at][0]

    def disjunction(self) -> Node:
        parts = [self.conjunction()]
        while self.kind == "OR":
            self.at += 1
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self) -> Node:
        parts = [self.negation()]
        while self.kind in ("AND", "NOT", "(", "leaf"):
            self.at += self.kind == "AND"
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self) -> Node:
        if self.kind == "NOT":
            self.at += 1
            return Not(self.negation())
        return self.atom()

    def atom(self) -> Node:
        kind, leaf = self.items[self.at]
        if kind == "leaf":
            self.at += 1
            return leaf
        if kind != "(":
            raise QuerySyntaxError("expected a term")
        self.at += 1
        inner = self.disjunction()
        if self.kind != ")":
            raise QuerySyntaxError("unbalanced parentheses")
        self.at += 1
        return inner


def parse(query: str) -> Node | None:
    """The syntax tree; None for a query without any term."""
    reader = _Reader(query)
    if reader.kind == "end":
        return None
    try:
        tree = reader.disjunction()
    except RecursionError:
        raise QuerySyntaxError("query is nested too deeply") from None
    if reader.kind != "end":
        raise QuerySyntaxError("unexpected token in query")
    return tree


def leaves(node: Node, negated: bool = False) -> Iterator[tuple[Term | Phrase, bool]]:
    """Every leaf, and whether it stands under an odd number of NOTs."""
    match node:
        case Term() | Phrase():
            yield node, negated
        case Not(part):
            yield from leaves(part, not negated)
        case And(parts) | Or(parts):
            for part in parts:
                yield from leaves(part, negated)


def _terms_of(leaf: Term | Phrase) -> tuple[str, ...]:
    return (leaf.term,) if isinstance(leaf, Term) else leaf.terms


def all_terms(node: Node) -> list[str]:
    return sorted({t for leaf, _ in leaves(node) for t in _terms_of(leaf)})


def scoring_terms(node: Node) -> list[str]:
    """Distinct terms that count for relevance, in byte order."""
    return sorted({t for leaf, negated in leaves(node) if not negated for t in _terms_of(leaf)})


def positional_terms(node: Node) -> list[str]:
    """Terms whose positions matter: those of phrases of two words and more."""
    return sorted({t for leaf, _ in leaves(node) if isinstance(leaf, Phrase) and len(leaf.terms) > 1 for t in leaf.terms})


def holds_for_absent(node: Node) -> bool:
    """Whether a document without any of the terms matches."""
    match node:
        case Term() | Phrase():
            return False
        case Not(part):
            return not holds_for_absent(part)
        case And(parts):
            return all(map(holds_for_absent, parts))
        case Or(parts):
            return any(map(holds_for_absent, parts))
