"""Searches over labelled trees, as expressions that the JVM evaluates.

A tree is a row of arrays in preorder: labels, and ends (the place behind each node's last descendant), so a node is the interval from its
place to its end. A pattern is a sequence of labels in preorder. The wildcard takes a node with all below it, which is a jump to the
node's end. A variable takes a node, too, and further on only a node that is equal to it with all below: that is a comparison of two slices.
An anchor stands only at the tree's begin or end. Nothing but the row is needed, so a search is one pass without a shuffle or Python.

`shared_subtrees` tells equal subtrees of all trees by a digest, from the leaves up: a round joins the digests of the last round to the nodes
above them. No tree is held in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut

WILD, ANCHOR = "？", "§"


def is_variable(token: str) -> bool:
    """A single letter from a to z, also a wide one."""
    return len(token) == 1 and ("a" <= token <= "z" or is_wide(token))


def is_wide(token: str) -> bool:
    """A variable where labels may be plain letters."""
    return len(token) == 1 and "ａ" <= token <= "ｚ"


def prefix_ends(labels: Column, arity: Mapping[str, int]) -> Column:
    """The ends of a tree in prefix order whose labels tell how many arguments follow. A place from which the arguments
    don't suffice has no end (null), and neither has what holds it."""
    many = F.create_map(*(F.lit(x) for kv in sorted(arity.items()) for x in kv))
    flat = F.sequence(F.lit(1), F.size(labels))  # without operators, each label is a node of its own

    def before(done: Column, label: Column) -> Column:
        # done: the ends behind this place, as distances from it; the k-th argument begins where the one before ends
        at = F.lit(1)
        for k in range(max(arity.values(), default=0)):
            end = at + F.get(done, at - 1)
            at = F.when(F.coalesce(F.element_at(many, label), F.lit(0)) > k, end).otherwise(at)
        return F.concat(F.array(at.cast("int")), done)

    sizes = F.aggregate(F.reverse(labels), F.array().cast("array<int>"), before)
    return F.when(F.arrays_overlap(labels, F.array(*(F.lit(x) for x in sorted(arity)))), F.transform(sizes, lambda x, i: x + i)).otherwise(flat)


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def places_sql(labels: str, ends: str, pattern: Sequence[str], own: Mapping[str, Sequence[Sequence[str]]] | None = None, shape: str | None = None, variable: Callable[[str], bool] = is_variable) -> str:
    """The places where a pattern matches (with an anchor first: the first place at most), as SQL over the SQL of a tree's arrays. own: for some
    labels, runs of labels in place of which they stand; the first that fits counts. shape: depths, where labels alone don't tell a subtree.
    Text, since a call for each part of it takes longer than the search."""
    n, known, names = f"size({labels})", own or {}, sorted({t for t in pattern if variable(t)})
    field = {v: f"v{k}" for k, v in enumerate(names)}

    def node(at: str) -> str:
        """What makes a node equal to another."""
        size = f"get({ends}, {at}) - {at}"
        if shape is None:
            return f"slice({labels}, {at} + 1, {size})"
        return f"zip_with(slice({labels}, {at} + 1, {size}), slice({shape}, {at} + 1, {size}), (x, d) -> concat_ws(' ', d - get({shape}, {at}), x))"

    def step(s: str, token: str, first: bool) -> str:
        at, bound = f"{s}.at", {v: f"{s}.{field[v]}" for v in names}
        if token == ANCHOR:
            to = f"if({at} = 0 OR {at} = {n}, {at}, NULL)"
        elif token == WILD:
            to = f"get({ends}, {at})"
        elif variable(token):
            # the first place binds, and the others compare
            to = f"get({ends}, {at})" if first else f"if({node(at)} = {bound[token]}, get({ends}, {at}), NULL)"
            if first:
                bound[token] = node(at)
        else:
            fits = [f"WHEN slice({labels}, {at} + 1, {len(x)}) = array({', '.join(map(_text, x))}) THEN {at} + {len(x)}" for x in known.get(token) or [[token]]]
            to = f"CASE {' '.join(fits)} END" if token in known else f"if(get({labels}, {at}) = {_text(token)}, {at} + 1, NULL)"
        return f"named_struct('at', CAST({to} AS INT)" + "".join(f", '{field[v]}', {bound[v]}" for v in names) + ")"

    state, seen = "array(named_struct('at', place" + "".join(f", '{field[v]}', CAST(NULL AS ARRAY<STRING>)" for v in names) + "))", set()
    for k, t in enumerate(pattern):
        # a transform binds the state, so that each step is evaluated once
        state = f"filter(transform({state}, s{k} -> {step(f's{k}', t, t not in seen)}), f{k} -> f{k}.at IS NOT NULL)"
        seen.add(t)
    every = "array(0)" if pattern[0] == ANCHOR else f"sequence(0, {n} - 1)"
    if not (pattern[0] in (ANCHOR, WILD) or pattern[0] in known or variable(pattern[0])):
        every = f"filter({every}, k -> get({labels}, k) = {_text(pattern[0])})"
    return f"filter(if({n} > 0, {every}, array()), place -> size({state}) > 0)"


def match_places(labels: str, ends: str, pattern: Sequence[str], own: Mapping[str, Sequence[Sequence[str]]] | None = None, shape: str | None = None, variable: Callable[[str], bool] = is_variable) -> Column:
    """As `places_sql`, of columns."""
    return F.expr(places_sql(labels, ends, pattern, own, shape, variable))


def tree_match(trees: DataFrame, patterns: Mapping[str, Sequence[str]], id_col: str) -> DataFrame:
    """id, pattern (its name) and n, in how many places it matches, if any, of trees (id, labels, ends, depths), one pass for all
    patterns. Variables are wide letters."""
    counts = [
        F.struct(F.lit(name).alias("pattern"), F.size(match_places("labels", "ends", tuple(p), shape="depths", variable=is_wide)).cast("long").alias("n")) for name, p in patterns.items()
    ]
    return trees.select(id_col, F.explode(F.array(*counts)).alias("x")).where("x.n > 0").select(id_col, "x.pattern", "x.n")


# ------------------------------------------------------------- shared subtrees


def subtree_digests(nodes: DataFrame, tree_col: str) -> DataFrame:
    """tree, pre, size, digest of every node of (tree, pre, end, depth, label, parent, rank): two nodes have one digest if they are equal with all below them.

    Level by level from the deepest: a node's digest is made of its label and, for each child, the child's digest and rank; the parts of the children
    are combined by xor, so a node of any number of children is summed in parts before the shuffle. Each level is written once."""
    depths = [r[0] for r in nodes.select("depth").distinct().orderBy(F.desc("depth")).collect()]  # as many rows as levels
    below: DataFrame | None = None
    done: list[DataFrame] = []
    for depth in depths:
        own = nodes.where(F.col("depth") == depth)
        if below is None:
            parts = own.select(tree_col, "pre", "end", "label", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        else:
            kids = below.groupBy(tree_col, F.col("parent").alias("pre")).agg(*(F.bit_xor(F.xxhash64(F.lit(k), "rank", "digest")).alias(c) for k, c in ((1, "a"), (2, "b"))))
            parts = own.join(kids, [tree_col, "pre"], "left").select(tree_col, "pre", "end", "label", F.coalesce("a", F.lit(0).cast("long")).alias("a"), F.coalesce("b", F.lit(0).cast("long")).alias("b"))
        made = parts.select(tree_col, "pre", (F.col("end") - F.col("pre")).alias("size"), F.md5(F.concat_ws(" ", F.col("a"), F.col("b"), F.col("label"))).alias("digest"))
        made = cut(made)
        done.append(made)
        if depth:
            ranked = own.select(tree_col, "pre", "parent", "rank")
            below = made.join(ranked, [tree_col, "pre"]).select(tree_col, "parent", "rank", "digest")
    out = nodes.select(tree_col, "pre", F.lit(0).alias("size"), F.lit("").alias("digest")).limit(0)
    for d in done:
        out = out.union(d)
    return out


def shared_subtrees(trees: DataFrame, id_col: str) -> DataFrame:
    """digest, size, n (how often) and trees (in how many) of each distinct subtree of trees (id, labels, ends, depths, parents)."""
    zipped = F.arrays_zip("labels", "ends", "depths", "parents")
    rows = trees.select(F.col(id_col).alias("tree"), F.posexplode(zipped).alias("pre", "x")).select(
        "tree", "pre", F.col("x.labels").alias("label"), F.col("x.ends").alias("end"), F.col("x.depths").alias("depth"), F.col("x.parents").alias("parent")
    )
    # a node's rank is its distance from the node above: equal in equal subtrees, and different among siblings
    found = subtree_digests(cut(rows.withColumn("rank", F.col("pre") - F.col("parent"))), "tree")
    return found.groupBy("digest", "size").agg(F.count("*").alias("n"), F.count_distinct("tree").alias("trees")).select("digest", F.col("size").cast("long").alias("size"), "n", "trees")
