"""Plain versions of tree matching, to hold the expressions to."""

from glyphmill.operators.structures import node_end
from glyphmill.operators.trees import is_variable


def match_at(tree, pattern, trees, start):
    at, bound = start, {}
    for t in pattern:
        if t == "§":
            if at not in (0, len(tree)):
                return False
        elif t == "？" or is_variable(t):
            end = node_end(tree, at)
            if end is None:
                return False
            if t != "？":
                old = bound.setdefault(t, tree[at:end])
                if tree[at : at + len(old)] != old:
                    return False
            at = end
        else:
            fit = next((a for a in trees.get(t) or [[t]] if tree[at : at + len(a)] == a), None)
            if fit is None:
                return False
            at += len(fit)
    return at <= len(tree)


def matches(tree, p, trees):
    places = range(min(1, len(tree)) if p.tokens[:1] == ("§",) else len(tree))
    return sum(match_at(tree, p.tokens, trees, k) for k in places)
