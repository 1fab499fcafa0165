"""The engine over a catalog of tables: documents, sequences, variants, and searches with paging."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import documents, graph, structures
from ..operators.derived import with_views
from ..operators.properties import Registry, character_registry, page
from ..sources.files import read_tables, write_tables


class BadRequest(ValueError):
    pass


def parse_char(text: str) -> str:
    """One character, as itself or as U+XXXX."""
    if m := re.search(r"U\+([0-9A-F]+)", text, re.I) if len(text) > 1 else None:
        n = int(m[1], 16)
        if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
            raise BadRequest(f"{text} is no character")
        text = chr(n)
    if len(text) != 1:
        raise BadRequest("one character is needed")
    return text


class Engine:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], registry: Registry | None = None):
        self.spark, self.tables = spark, with_views(tables)
        self.registry = registry or character_registry()
        self._rels: DataFrame | None = None
        stored = [self.tables.get(n) for n in ("documents", "tokens", "postings")]
        self.index = structures.Index(*stored) if all(t is not None for t in stored) else None

    def document(self, chars: Sequence[str] | DataFrame, select: Sequence[str] | None = None) -> DataFrame:
        batch = chars if isinstance(chars, DataFrame) else self.spark.createDataFrame([(parse_char(c),) for c in chars], "char string")
        return documents.character_documents(self.tables, batch, select)

    def ivs_list(self, char: str) -> DataFrame:
        return documents.sequence_list(self.tables["ivs"], parse_char(char))

    def variants(self, chars: Sequence[str] | DataFrame) -> DataFrame:
        if self._rels is None:
            self._rels = graph.edges(self.tables)
        seeds = chars if isinstance(chars, DataFrame) else [parse_char(c) for c in chars]
        return graph.variants(self._rels, seeds)

    def find(self, ids: Sequence[str] = (), whole: Sequence[str] = (), p: Sequence[str] = (), q: Sequence[str] = (), limit: str | int | None = None, offset: str | int | None = None, all_results: bool = False) -> dict:
        """results (r, in order), done (nothing is left after a limited page) and total (of unpaged results)."""
        if len(p) != len(q):
            raise BadRequest("p and q must be as many")
        if not (ids or whole or p):
            raise BadRequest("No parameters")
        if ids or whole:
            found = structures.search(self.tables.get("structures"), ids, whole, self.index).select(F.col("UCS").alias("r"))
            if not all_results:
                found = found.where(~F.col("r").startswith("&"))
            for k, v in zip(p, q, strict=True):
                found = found.join(self.registry.find(self.tables, k, v), "r", "left_semi")
        else:
            found = self.registry.search(self.tables, p, q)
        if limit or not offset:
            found = cut(found)  # searched once: for the rows, and for how many there are or whether more
        rows, paged = page(found, limit, offset)
        size = page(found, limit)[0] if limit else None
        out: dict = {"results": rows}
        if not paged:
            out["total"] = found.count()
        elif size is not None:
            skip = int(re.match(r"\s*\+?(\d+)", str(offset or 0))[1]) if offset and re.match(r"\s*\+?(\d+)", str(offset)) else 0
            n = re.match(r"\s*\+?(\d+)", str(limit))
            out["done"] = not n or int(n[1]) == 0 or found.orderBy("r").offset(skip + int(n[1])).limit(1).isEmpty()
        return out

    def candidates(self, ids: Sequence[str], view: str = "results") -> DataFrame:
        """The characters that a structure search has to look at, also as a view for SQL."""
        docs = structures.documents(self.tables["structures"])
        asked = [g for g in (structures.overlaid_orders(structures.tokenize(i)) for i in ids) if g[0].tokens]
        known: dict[str, list[str]] = {}
        names = {t for g in asked for x in g for t in x.tokens}
        for r in self.tables["structures"].where(F.col("UCS").isin(sorted(names))).collect():
            known.setdefault(r.UCS, []).append(r.IDS_tokens)
        out = docs.where(structures.candidate_test(asked, known, F.col("doc"))).select("UCS")
        out.createOrReplaceTempView(view)
        return out


def build(tables: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """From loaded tables to a searchable catalog in a folder: the tables and the views that follow from them,
    `structures` (full decompositions of `ids` with the map of variants of `unihan` and `kdpv`, and of `usource`'s
    characters without a code point), and the index of its documents."""
    made = with_views(tables)
    if "ids" in made:
        expand = structures.variant_map(made.get("unihan"), made.get("kdpv"))
        extra = structures.entities(made["usource"]) if "usource" in made else None
        spark = made["ids"].sparkSession
        write_tables({"structures": structures.decompose_table(made["ids"], extra, expand)}, folder)
        made["structures"] = read_tables(spark, folder, ["structures"])["structures"]
        made |= structures.index_tables(made["structures"])
    rest = {n: t for n, t in made.items() if n != "structures"}
    write_tables(rest, folder, keys={"documents": "UCS", "postings": "token", "tokens": "token", "unihan_value_ref": "ref", "ids": "UCS", "unihan": "UCS"})
    return read_tables(next(iter(made.values())).sparkSession, folder, made)


def joined_trees(ids: DataFrame, char: str) -> str:
    """A character's distinct trees, comma-joined, in order."""
    return ",".join(r.IDS for r in ids.where(F.col("UCS") == char).select("IDS").distinct().orderBy("IDS").collect())


def decompose_text(ids: DataFrame, char: str, show_source: bool = False, quote: bool = False) -> DataFrame:
    """(source, ids) of a character's full trees for every source letter, projections carried out; trees
    that can't be are skipped; without sources each tree once. Only the rows that the character can reach are read."""
    trees = cut(structures.trees_of(ids))  # read once a level
    letters = "B G H J K M P S T U V X Z UCS2003".split()
    table: dict[str, dict[str, list[str]]] = {}
    met = front = {char}
    while front:
        found = sorted(tuple(r) for r in trees.where(F.col("UCS").isin(sorted(front))).collect())
        for u, s, t in found:
            table.setdefault(u, {}).setdefault(s, []).append(t)
        front = {x for _, _, t in found for x in t.split(" ")} - structures.ARITY.keys() - met
        met = met | front
    d, rows, seen = structures.Decomposer(table), [], set()
    for s in letters:
        for tree in d.decompose(char, s):
            try:
                text = "".join(structures.project(tree))
            except ValueError:
                continue
            text = f"§{text}§" if quote else text
            if show_source or text not in seen:
                rows.append((s if show_source else None, text))
            seen.add(text)
    return ids.sparkSession.createDataFrame(rows, "source string, ids string")
