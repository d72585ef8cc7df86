"""The query semantics on Python sets and dicts: what the engine is held against."""

from __future__ import annotations

import math
from collections import defaultdict

from lexiloom.functions.text import words
from lexiloom.plans.query import And, Not, Or, Phrase, Term, parse, scoring_terms


class Corpus:
    def __init__(self, docs: dict[int, str]):
        self.tokens = {i: words(t) for i, t in docs.items()}
        self.places: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, ts in self.tokens.items():
            for p, t in enumerate(ts):
                self.places[t][i].append(p)
        self.average = sum(map(len, self.tokens.values())) / len(docs) if docs else 0.0

    def match(self, node) -> set[int]:
        match node:
            case Term(t):
                return set(self.places.get(t, ()))
            case Phrase(ts):
                return {i for i, own in self.tokens.items() if ts and any(tuple(own[p : p + len(ts)]) == ts for p in range(len(own)))}
            case Not(part):
                return set(self.tokens) - self.match(part)
            case And(parts):
                return set.intersection(*map(self.match, parts))
            case Or(parts):
                return set.union(*map(self.match, parts))

    def search(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> list[tuple[int, float]]:
        tree = parse(query)
        if tree is None:
            return []
        n, out = len(self.tokens), []
        for i in self.match(tree):
            score = 0.0
            for t in scoring_terms(tree):
                if i in self.places.get(t, ()):
                    df, tf = len(self.places[t]), len(self.places[t][i])
                    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                    score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(self.tokens[i]) / self.average))
            out.append((i, score))
        return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:k]
