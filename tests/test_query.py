import pytest

from lexiloom.plans.query import And, Not, Or, Phrase, QuerySyntaxError, Term, all_terms, holds_for_absent, parse, positional_terms, scoring_terms

A, B, C = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("a b", And((A, B))), ("a and B", And((A, B))), ("a OR b c", Or((A, And((B, C))))), ("(a or b) c", And((Or((A, B)), C))),
        ("NOT NOT a", Not(Not(A))), ("a NOT b", And((A, Not(B)))), ('"a b', Phrase(("a", "b"))), ('""', Phrase(())), ("a-b", Phrase(("a", "b"))),
        ("a , b", And((A, B))), ('"and"', Phrase(("and",))), ("and,", Term("and")), ("a\vb", And((A, B))), ("", None), ("  ", None), ("!!!", None),
        ("a b", Phrase(("a", "b"))), ("é", None),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("(a", "unbalanced parentheses"), ("(quick AND brown", "unbalanced parentheses"), ("a)", "unexpected token in query"),
        *[(q, "expected a term") for q in ("AND", "a AND", "OR a", "NOT", "()", "a AND OR b", "a AND AND b", "a OR OR b", "a AND ,", "the and NOT and")],
    ],
)
def test_errors(query, message):
    with pytest.raises(QuerySyntaxError, match=message):
        parse(query)


def test_deep_nesting_is_an_error():
    with pytest.raises(QuerySyntaxError):
        parse("(" * 100_000 + "a")


def test_term_sets():
    tree = parse('NOT (a AND NOT "b c") OR d d')
    assert scoring_terms(tree) == ["b", "c", "d"]
    assert all_terms(tree) == ["a", "b", "c", "d"]
    assert positional_terms(tree) == ["b", "c"]
    assert holds_for_absent(tree) and not holds_for_absent(parse("a NOT b"))
