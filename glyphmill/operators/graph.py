"""The graph of character variants: directed, labelled edges, strong and weak, and what seeds reach."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut, shared_folder

# Relations along which a search does not go on.
WEAK = (
    "kSpoofingVariant",
    "kSpecializedSemanticVariant",
    "民一2842号通達別表_誤字俗字正字一覧表_別字",
    "入管正字_類字_第1順位",
    "入管正字_類字_第2順位",
    "同音の漢字による書きかえ",
    "cjkvi/non-cognate",
)


def is_strong(r: Column) -> Column:
    return ~(r.isin(*WEAK) | r.rlike("^kStrange_.$"))


def edges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(c1, c2, r): twelve kinds of relations between characters; rows without both ends are dropped."""
    one = lambda a, b: (F.length(a) == 1) & (F.length(b) == 1)
    t = tables
    kdpv = t["kdpv"].where(F.col("rel").isin("cjkvi/duplicate", "cjkvi/non-cognate", "jisx0212/variant", "jisx0213/variant") & one("subject", "object"))
    mjsm = (
        t["mjsm"].where((F.coalesce("ホップ数", F.lit(1)) < 2) & ~F.col("表").startswith("法務省告示582号"))
        .join(t["mji"].select("MJ文字図形名", F.coalesce("実装したUCS", "対応するUCS").alias("own")), "MJ文字図形名")
    )
    parts = [
        t["unihan_variant"].select("UCS", "value", "property"),
        t["unihan_strange"].where(F.col("category").isin(*"FMORI")).select("UCS", "value", F.concat(F.lit("kStrange_"), "category")),
        mjsm.select("own", "縮退UCS", "表"),
        t["nyukan"].select("簡体字等のUCS", "正字のUCS", F.concat(F.lit("入管正字_"), "正字の種類", F.lit("_第"), F.col("順位").cast("string"), F.lit("順位"))),
        t["doon"].select("書きかえる漢字", "書きかえた漢字", F.lit("同音の漢字による書きかえ")).distinct(),
        t["joyo_kangxi"].select("康熙字典体", "漢字", F.lit("常用漢字表_新字体")),
        kdpv.select("subject", "object", "rel"),
        t["tghb_variants"].where((F.length("异体字") == 1) & (F.col("异体字") != F.col("繁体字"))).select("异体字", "繁体字", F.lit("tghb_异体字")),
        t["tghb_variants"].select("繁体字", "规范字", F.lit("tghb_规范字")),
    ]
    out = parts[0].toDF("c1", "c2", "r")
    for p in parts[1:]:
        out = out.union(p.toDF("c1", "c2", "r"))
    return out.dropna()


#: So many characters may a search name to its rounds; beyond, its fronts are tables.
FEW = 20_000


def variants(rels: DataFrame, seeds: DataFrame | Sequence, weak: Column | None = None, few: int = FEW) -> DataFrame:
    """Edges (c1, c2, r, f) that touch what the seeds reach, either way round, along pairs with a strong
    relation. f is 1 if any relation of the directed pair is strong. seeds: values or a one-column table.

    The strong pairs are stored once, both ways round, in order of their ends. A round reads the row groups that its new characters are
    in, as a filter on that order, and is one job; up to `few` characters in all. A search that reaches more goes on with tables: a round joins the
    new characters, and written to the checkpoint folder they cut the plan."""
    spark = rels.sparkSession
    kind = rels.schema["c1"].dataType.simpleString()
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(s,) for s in seeds], f"c {kind}")
    strong = ~weak if weak is not None else is_strong(F.col("r"))
    ends = _stored_ends(rels, weak)
    begin = seeds.toDF("c").dropna().distinct()
    known = _values(begin, few)
    front = known
    while known is not None and front:
        new = _values(ends.where(_is_one_of("c", front, kind)).select(F.col("to").alias("c")).distinct(), few)
        front = None if new is None else new - known
        known = None if front is None or len(known) + len(front) > few else known | front
    seen = _reached(ends, begin) if known is None else spark.createDataFrame([(k,) for k in sorted(known)], f"c {kind}")
    # two equi-joins instead of one on either end, which would compare all pairs
    a = rels.join(seen, rels["c1"] == seen["c"], "left_semi")
    b = rels.join(seen, rels["c2"] == seen["c"], "left_semi").join(seen, F.col("c1") == seen["c"], "left_anti")
    met = a.unionByName(b)
    pairs = met.groupBy("c1", "c2").agg(F.max(strong.cast("int")).alias("f"))  # all rows of a pair are met, or none
    return met.join(pairs, ["c1", "c2"]).select("c1", "c2", "r", "f")


def _stored_ends(rels: DataFrame, weak: Column | None) -> DataFrame:
    folder = f"{shared_folder(rels.sparkSession)}/glyphmill-ends-{uuid.uuid4().hex}"
    ends = strong_ends(rels, weak)
    ends.sortWithinPartitions("c").write.parquet(folder)  # dealt by both columns: a front's rows are spread
    return rels.sparkSession.read.schema(ends.schema).parquet(folder)


def _values(table: DataFrame, few: int) -> set | None:
    """The values of a column, if they are few."""
    rows = table.limit(few + 1).collect()
    return None if len(rows) > few else {r[0] for r in rows}


def _is_one_of(name: str, values: set, kind: str) -> Column:
    """As text, since a call for each literal takes longer than the scan."""
    if kind == "string":
        quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    elif kind in ("int", "bigint"):
        quoted = [f"{v}L" if kind == "bigint" else str(v) for v in values]
    else:
        return F.col(name).isin(*values)
    return F.expr(f"{name} IN ({', '.join(quoted)})")


def _reached(ends: DataFrame, begin: DataFrame) -> DataFrame:
    """What is reached from many characters, by rounds of tables."""
    seen = front = cut(begin)
    while not front.isEmpty():
        front = cut(ends.join(front, "c", "left_semi").select(F.col("to").alias("c")).distinct().join(seen, "c", "left_anti"))
        seen = seen.union(front)  # of checkpoints: none is written again
    return cut(seen)


def strong_ends(rels: DataFrame, weak: Column | None = None) -> DataFrame:
    """(c, to): both ways round, the pairs with a strong relation."""
    strong = ~weak if weak is not None else is_strong(F.col("r"))
    pairs = rels.where(strong).select(F.col("c1").alias("c"), F.col("c2").alias("to"))
    return pairs.union(pairs.select("to", "c")).where("c <> to").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(c, component) of every end of pairs (c, to) of unlike ends: component is the smallest end that it is linked to, through any others.

    Large and small stars in turn: each end's larger neighbours are linked to its smallest one, then all its smaller ones to the smallest of them,
    until every end's one link is to an end without a link. A round holds as many rows as there were pairs at most, and rounds are about the
    logarithm of the ends."""
    now = cut(pairs.select(F.greatest("c", "to").alias("a"), F.least("c", "to").alias("b")).distinct())
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        large = now.join(least.toDF("b", "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = cut(large)
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(near.select("a", F.col("m").alias("b"))).distinct())
        links, nodes = now.agg(F.count("*"), F.count_distinct("a")).first()
        if links == nodes and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    roots = now.select(F.col("b").alias("c"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("c"), F.col("b").alias("component")).union(roots)


def reach_components(rels: DataFrame, seeds: DataFrame, weak: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What each of many seeds reaches through strong pairs, which hold either way round: (seed, component), a row a seed, and (component, c), all
    members once, the seed itself included. Neither grows with how much the seeds reach together."""
    members = cut(components(strong_ends(rels, weak)))
    seeds = cut(seeds.toDF("seed").dropna().distinct())
    own = seeds.join(members.withColumnRenamed("c", "seed"), "seed", "left").select("seed", F.coalesce("component", "seed").alias("component"))
    alone = seeds.join(members.withColumnRenamed("c", "seed"), "seed", "left_anti").select(F.col("seed").alias("component"), F.col("seed").alias("c"))
    return own, members.select("component", "c").union(alone)


def reach(rels: DataFrame, seeds: DataFrame, weak: Column | None = None) -> DataFrame:
    """(seed, c): for each of many seeds, all that it reaches through strong pairs, itself included. As many rows as that is: sums over what seeds reach
    are taken by component (`reach_components`)."""
    own, members = reach_components(rels, seeds, weak)
    return own.join(members, "component").select("seed", "c")


def mermaid(rows: Sequence[tuple[str, str, str, int]], seeds: Sequence[str] = ()) -> str:
    """A flow chart of variant rows: each pair once whichever way round, weak relations dashed."""
    lines, named, drawn = ["graph LR"], {}, set()
    for c1, c2, r, f in sorted(rows):
        for c in (c1, c2):
            if c not in named:
                named[c] = f"n{len(named)}"
                lines.append(f'  {named[c]}["{c} U+{ord(c[0]):04X}"]')
        key = (*sorted((c1, c2)), r, bool(f))
        if key not in drawn:
            drawn.add(key)
            arrow = "---" if f else "-.-"
            lines.append(f'  {named[c1]} {arrow}|"{r}"| {named[c2]}')
    lines += [f"  style {named[s]} stroke-width:4px" for s in seeds if s in named]
    return "\n".join(lines)
