"""Command line over a folder of Parquet tables: python -m glyphmill TABLES COMMAND ...

find [--whole] [--limit N] [--all] PATTERN...      characters with all the patterns
search KEY=VALUE...                                characters for which all keys hold
document CHAR... [--select FIELD,...]              JSON documents
ivs CHAR                                           variation sequences
variants CHAR... [--mermaid]                       the variant graph around characters
decompose CHAR [--show-source] [-q]                full description trees
build FOLDER                                       views, full decompositions and a search index, with TABLES' tables
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession

from .operators.graph import mermaid
from .plans.engine import Engine, build, decompose_text
from .sources.files import read_tables


def bare(pattern: str) -> str:
    """A pattern without variation selectors."""
    return re.sub("[︀-️\U000e0100-\U000e01ef]", "", pattern)


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="glyphmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("tables")
    p.add_argument("command", choices=["find", "search", "document", "ivs", "variants", "decompose", "build"])
    p.add_argument("values", nargs="+")
    p.add_argument("--whole", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--all", action="store_true")
    p.add_argument("--select", default="")
    p.add_argument("--mermaid", action="store_true")
    p.add_argument("--show-source", action="store_true")
    p.add_argument("-q", dest="quote", action="store_true")
    a = p.parse_args(args)
    if a.limit is not None and a.limit < 0:
        print("--limit must be 0 or more", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.tables)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    engine = Engine(spark, read_tables(spark, a.tables, [s.getPath().getName() for s in found if s.isDirectory()]))
    if a.command in ("find", "search"):
        if a.command == "find":
            ids = [bare(v) for v in a.values]
            rows = engine.find(**{"whole" if a.whole else "ids": ids}, all_results=a.all)["results"]
        else:
            pairs = [v.partition("=") for v in a.values]
            rows = engine.find(p=[k for k, _, _ in pairs], q=[v for _, _, v in pairs])["results"]
        for r in (rows if a.limit is None else rows.limit(a.limit)).toLocalIterator():
            print(r.r)
    elif a.command == "document":
        for r in engine.document(a.values, [f for f in a.select.split(",") if f]).toLocalIterator():
            print(r.document)
    elif a.command == "ivs":
        for r in engine.ivs_list(a.values[0]).toLocalIterator():
            print(*r, sep="\t")
    elif a.command == "variants":
        rows = [tuple(r) for r in engine.variants(a.values).collect()]
        print(mermaid(rows, a.values) if a.mermaid else "\n".join("\t".join(map(str, r)) for r in sorted(rows)))
    elif a.command == "build":
        for name, table in build(engine.tables, a.values[0]).items():
            print(name, table.count(), sep="\t")
    else:
        for r in decompose_text(engine.tables["ids"], a.values[0], a.show_source, a.quote).collect():
            print(*([r.source] if r.source else []), r.ids, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
