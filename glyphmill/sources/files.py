"""Readers of the public character-data files, each giving one or more tables; and table sinks.

Schemas are stated, never inferred. Files are read as lines where their syntax is not plain CSV.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X


def lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """(line) of a text file without blank lines, comments, a byte-order mark and carriage returns."""
    df = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^﻿", "").alias("line"))
    df = df.where(F.trim("line") != "")
    return df.where(~F.col("line").startswith(comment)) if comment else df


def fields(mark: str, names: Sequence[str], line: str = "line") -> list[Column]:
    parts = F.split(line, mark)
    return [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]


def text_schema(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """All columns as text, named by the header (without a byte-order mark); empty cells are null."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    names = next(iter(_csv_row(first[0].lstrip("﻿"), sep, quote)))
    df = spark.read.schema(text_schema(f"c{k}" for k in range(len(names)))).csv(path, sep=sep, header=header, quote=quote, escape=quote, multiLine=bool(quote), enforceSchema=True, emptyValue="")
    df = df.toDF(*names)
    return df.select(*(F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))


def _csv_row(text: str, sep: str, quote: str) -> Iterable[list[str]]:
    import csv as plain

    return plain.reader([text], delimiter=sep, quotechar=quote or None, quoting=plain.QUOTE_MINIMAL if quote else plain.QUOTE_NONE)


# ------------------------------------------------------------- MJ character list

# Columns of the MJ list, with the kinds that aren't text.
MJI = (
    "MJ文字図形名 対応するUCS 実装したUCS 実装したMoji_JohoコレクションIVS 実装したSVS 戸籍統一文字番号 住基ネット統一文字コード 入管正字コード "
    "入管外字コード 漢字施策 対応する互換漢字 X0213 X0213_包摂連番 X0213_包摂区分 X0212 MJ文字図形バージョン 登記統一文字番号 総画数 大漢和 "
    "日本語漢字辞典 新大字典 大字源 大漢語林 備考"
).split()
MJI_NUMBERS = {"X0213_包摂区分", "総画数", "大漢和", "日本語漢字辞典", "新大字典", "大字源", "大漢語林"}
MJI_CODES = {"対応するUCS", "実装したUCS", "対応する互換漢字"}


def mji(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """mji, mji_duplicated_ivs, mji_reading, mji_rsindex and mji_changelog of the list's CSV file."""
    raw = csv(spark, path)
    raw = raw.toDF(*(c.replace(" ", "_") for c in raw.columns))
    named = {c.removesuffix("(参考)"): c for c in raw.columns}
    sequences = F.transform(F.split("実装したMoji_JohoコレクションIVS", ";"), X.sequence_char)
    own = F.array_position(F.transform(F.col("_ivs"), X.first_char), F.col("対応するUCS"))
    flat = raw.select(
        *(
            (X.u_char(f"`{named[c]}`") if c in MJI_CODES else sequences.alias("_ivs") if c.endswith("IVS") else X.sequence_char(f"`{named[c]}`") if c == "実装したSVS" else F.col(f"`{named[c]}`").try_cast("long") if c in MJI_NUMBERS else F.col(f"`{named[c]}`")).alias("_ivs" if c.endswith("IVS") else c)
            for c in MJI
        ),
        *(F.col(f"`{c}`") for c in raw.columns if c.removesuffix("(参考)") not in MJI),
    )
    # the first sequence of the character itself is its own, the others are extra
    flat = flat.withColumn("_own", F.when(own > 0, own))
    table = flat.withColumn("実装したMoji_JohoコレクションIVS", F.get("_ivs", (F.col("_own") - 1).cast("int"))).select(*MJI)
    extra = flat.select("MJ文字図形名", F.posexplode("_ivs").alias("k", "重複実装したMoji_JohoコレクションIVS"), "_own").where(~(F.col("k") + 1).eqNullSafe(F.col("_own"))).drop("k", "_own")
    each = lambda c, mark, name: raw.where(F.col(f"`{c}`").isNotNull()).select("MJ文字図形名", F.explode(F.split(F.col(f"`{c}`"), mark)).alias(name))
    radicals = F.explode(F.array(*(F.struct(F.col(f"`部首{k}(参考)`").try_cast("long").alias("部首"), F.col(f"`内画数{k}(参考)`").try_cast("long").alias("内画数")) for k in range(1, 5)))).alias("x")
    return {
        "mji": table,
        "mji_duplicated_ivs": extra,
        "mji_reading": each("読み(参考)", "・", "読み"),
        "mji_rsindex": raw.select("MJ文字図形名", radicals).select("MJ文字図形名", "x.部首", "x.内画数").where("`部首` is not null and `内画数` is not null"),
        "mji_changelog": each("更新履歴", ";", "更新履歴"),
    }


# The rules of the shrink map.
SHRINK_RULES = ("JIS包摂規準・UCS統合規則", "法務省戸籍法関連通達・通知", "法務省告示582号別表第四", "辞書類等による関連字", "読み・字形による類推")


def mjsm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """mjsm, with the rule table's name in 表, and mjsm_note, of the shrink map's JSON file."""
    mapping = "struct<`JIS X 0213`:string,UCS:string,`種別`:string,`表`:string,`付記`:string,`順位`:string,`ホップ数`:int>"
    schema = f"content array<struct<`MJ文字図形名`:string,`参考情報`:string,{','.join(f'`{r}`:array<{mapping}>' for r in SHRINK_RULES)}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("content"))
    parts = []
    for rule in SHRINK_RULES:
        m = rows.select("MJ文字図形名", F.explode(F.col(f"`{rule}`")).alias("m"))
        name = F.array_join(F.filter(F.array(F.coalesce(F.nullif("m.種別", F.lit("")), F.lit(rule)), F.coalesce(F.nullif("m.表", F.lit("")), F.col("m.付記"))), lambda x: x.isNotNull() & (x != "")), "_")
        parts.append(
            m.select(
                "MJ文字図形名", X.u_char("m.UCS").alias("縮退UCS"), F.col("m.`JIS X 0213`").alias("縮退X0213"), F.replace(F.translate(name, " ", "_"), F.lit("・")).alias("表"),
                F.substring("m.順位", 2, 1).try_cast("int").alias("順位"), F.col("m.ホップ数").alias("ホップ数"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return {"mjsm": out, "mjsm_note": rows.where("`参考情報` <> ''").select("MJ文字図形名", "参考情報")}


def mjih(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """mjih and mjih_phonetic of the kana list's CSV file."""
    raw = csv(spark, path).withColumnRenamed("font文字", "文字")
    names = "MJ文字図形名 文字 CharacterName UCS符号位置 字母 字母のUCS符号位置 戸籍統一文字番号 学術用変体仮名番号 国語研URL 備考".split()
    sounds = raw.select("MJ文字図形名", "文字", F.explode(F.array(*(F.col(f"音価{k}") for k in "１２３"))).alias("音価")).where("`音価` is not null")
    return {"mjih": raw.select(*names), "mjih_phonetic": sounds}


# ------------------------------------------------------------- Unicode files


def ivs(spark: SparkSession, path: str) -> DataFrame:
    """(IVS, collection, code) of a CSV of sequences; CID codes are written CID+n."""
    raw = csv(spark, path)
    code = F.when(F.col("collection") == "Adobe-Japan1", F.concat(F.lit("CID+"), F.substring("code", 5, 9).try_cast("long").cast("string"))).otherwise(F.col("code"))
    return raw.select(X.sequence_char("IVS").alias("IVS"), "collection", code.alias("code"))


def ivd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(IVS, collection, code) as text of a database file of `base selector; collection; code` lines."""
    m = lambda k: F.regexp_extract("line", r"^([0-9A-F]+) ([0-9A-F]+); *([^;]+?); *(\S+)", k)
    return lines(spark, path).where(m(1) != "").select(F.concat(m(1), F.lit("_"), m(2)).alias("IVS"), m(3).alias("collection"), m(4).alias("code"))


def svs_lines(spark: SparkSession, path: str) -> DataFrame:
    """(SVS, CJKCI) of `base selector; CJK COMPATIBILITY IDEOGRAPH-XXXX` lines."""
    m = lambda k: F.regexp_extract("line", r"^([0-9A-F]+) ([0-9A-F]+); *CJK COMPATIBILITY IDEOGRAPH-([0-9A-F]+)", k)
    return lines(spark, path).where(m(1) != "").select(F.concat(X.hex_char(m(1)), X.hex_char(m(2))).alias("SVS"), X.hex_char(m(3)).alias("CJKCI"))


def radicals(spark: SparkSession, path: str) -> DataFrame:
    """The radicals file, `number; radical; ideograph`, with as many ' after the number as it is simplified."""
    f = lines(spark, path).select(*fields("; *", ("n", "c", "u")))
    mark = F.length(F.regexp_extract("n", "('*)$", 1))
    return with_radical_names(f.select(F.regexp_extract("n", r"^(\d+)", 1).cast("int").alias("radical_number"), mark.alias("radical_simplified"), X.hex_char("c").alias("radical_character"), X.hex_char(F.trim("u")).alias("radical_CJKUI")))


def with_radical_names(df: DataFrame) -> DataFrame:
    """The columns that follow from a radical's number and simplification."""
    return df.select(
        F.concat(F.col("radical_number").cast("string"), F.repeat(F.lit("'"), F.col("radical_simplified"))).alias("radical"), "radical_number", "radical_simplified",
        "radical_character", "radical_CJKUI", F.when(F.col("radical_simplified") == 0, F.col("radical_number")).alias("部首"), F.col("radical_CJKUI").alias("部首漢字"),
    )


def radical_equivalents(spark: SparkSession, path: str) -> DataFrame:
    """(radical_character, radical_CJKUI): ranges a row each; radicals that comments list without one are null."""
    every = lines(spark, path, None)
    none = F.regexp_extract("line", r"^# ([0-9A-F]{4,5}); CJK [A-Za-z0-9_ ]+$", 1)
    body = every.select(F.trim(F.regexp_replace("line", "#.*", "")).alias("line")).where("line <> ''").select(*fields(";", ("codes", "to")))
    number = lambda c: F.conv(F.trim(c), 16, 10).cast("int")
    ends = F.split("codes", r"\.\.")
    many = body.select(F.explode(F.sequence(number(F.get(ends, F.lit(0))), number(F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))))).alias("n"), X.hex_char(F.trim("to")).alias("radical_CJKUI"))
    rest = every.where(none != "").select(X.hex_char(none).alias("radical_character"), F.lit(None).cast("string").alias("radical_CJKUI"))
    return many.select(X.char_of("n").alias("radical_character"), "radical_CJKUI").unionByName(rest)


def usource(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """usource and usource_source of the semicolon file; entities in trees don't part fields."""
    safe = lines(spark, path).select(F.regexp_replace(F.get(F.split("line", "\t"), F.lit(0)), "&([^;]+);", "\u0001$1\u0002").alias("line"))
    f = safe.select(*fields(";", ("U_source_ID", "status", "cp", "RS", "VKXDP", "ids", "sources", "comments", "ts", "frs")))
    back = lambda c: F.regexp_replace(c, "\u0001([^\u0002]+)\u0002", "&$1;")
    table = f.select("U_source_ID", "status", X.u_char("cp").alias("UCS"), "RS", "VKXDP", F.nullif(back("ids"), F.lit("")).alias("IDS"), back("comments").alias("comments"), F.col("ts").try_cast("int").alias("TS"), F.col("frs").try_cast("int").alias("FRS"))
    return {"usource": table, "usource_source": f.select("U_source_ID", F.explode(F.split("sources", r"\*")).alias("source")).where("source <> ''")}


def unihan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(UCS, property, value) of the database's tab-separated files."""
    return lines(spark, paths).select(*fields("\t", ("c", "property", "value"))).select(X.u_char("c").alias("UCS"), "property", "value").dropna()


def space_delimited(metadata: str) -> list[str]:
    """Names of the properties whose values are lists, of the property metadata's JSON text."""
    return [p["Property"] for p in json.loads(metadata) if p.get("Delimiter") == "space"]


# ------------------------------------------------------------- trees, with files laid over each other


def ids(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """ids and ids_comment of tab-separated files `U+X, character, ^tree$(sources)... [*comment;comment]`.
    A character's last record, in the last file that has it, replaces all its others. Any other field is
    an error, but for U+276AD, where it is a comment."""
    rows = None
    for k, path in enumerate(paths):
        # a line's place in its file: the split's number and the place in it rise together
        own = lines(spark, path).select("line", F.lit(k).alias("file"), F.monotonically_increasing_id().alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    parts = F.split("line", "\t")
    rec = rows.where(F.size(parts) >= 2).select(F.trim(F.get(parts, F.lit(0))).alias("code"), F.trim(F.get(parts, F.lit(1))).alias("UCS"), F.slice(parts, 3, 1000).alias("fields"), "file", "at").where("UCS <> ''")
    rec = rec.withColumn("fields", F.when(F.size("fields") > 0, F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("missing fields: "), "code"))))
    last = rec.groupBy("UCS").agg(F.max_by(F.struct("code", "fields"), F.struct("file", "at")).alias("r"))
    each = last.select("UCS", "r.code", F.posexplode("r.fields").alias("k", "f")).withColumn("f", F.trim("f")).where("f <> ''")
    tree = F.regexp_extract("f", r"\^([^$]+)\$\(([^)]+)\)", 0) != ""
    note = F.col("f").startswith("*") | ((F.col("UCS") == "\U000276ad") & ~F.col("f").startswith("^"))
    kind = F.when(F.col("f").startswith("^") & tree, "tree").when(note, "comment").otherwise(F.raise_error(F.concat(F.lit("syntax error: "), "code")))
    each = each.withColumn("kind", kind)
    m = lambda k: F.regexp_extract("f", r"\^([^$]+)\$\(([^)]+)\)", k)
    comment = F.explode(F.split(F.regexp_replace("f", r"^\*", ""), ";"))
    return {
        "ids": each.where("kind = 'tree'").select("UCS", m(2).alias("source"), m(1).alias("IDS")),
        "ids_comment": each.where("kind = 'comment'").select("UCS", comment.alias("c")).select("UCS", F.trim("c").alias("comment")),
    }


# ------------------------------------------------------------- others

CMAPS = ("UniJIS", "UniJIS2004", "UniJISX0213", "UniJISX02132004")


def aj1(spark: SparkSession, path: str) -> DataFrame:
    """(CID, UCS, vertical, a flag for each map) of the tab-separated code table."""
    raw = lines(spark, path)
    head = raw.where(F.col("line").startswith("CID\t")).first()[0].split("\t")
    df = raw.where(~F.col("line").startswith("CID\t")).select(*fields("\t", head))
    units = None
    for m in CMAPS:
        own = df.where(F.col(f"`{m}-UTF32`") != "*").select(F.col("CID").cast("int").alias("CID"), F.explode(F.split(f"`{m}-UTF32`", ",")).alias("u"))
        own = own.select("CID", X.hex_char(F.rtrim(F.regexp_replace("u", "v$", ""))).alias("UCS"), F.col("u").endswith("v").cast("int").alias("vertical"), *(F.lit(int(x == m)).alias(x) for x in CMAPS))
        units = own if units is None else units.unionByName(own)
    return units.groupBy("CID", "UCS", "vertical").agg(*(F.sum(m).cast("int").alias(m) for m in CMAPS))


def joyo(spark: SparkSession, records: Sequence[dict]) -> dict[str, DataFrame]:
    """joyo, joyo_acceptable and joyo_kangxi of the list's records."""
    rows = [(r["subject"], r.get("reading"), json.dumps(r.get("examples") or [], ensure_ascii=False, separators=(",", ":")), r.get("note")) for r in records]
    return {
        "joyo": spark.createDataFrame(rows, text_schema(("漢字", "音訓", "例", "備考"))),
        "joyo_acceptable": spark.createDataFrame([(r["acceptable"],) for r in records if r.get("acceptable")], text_schema(["漢字"])).distinct(),
        "joyo_kangxi": spark.createDataFrame([(r["subject"], k) for r in records for k in r.get("kangxi") or ()], text_schema(("漢字", "康熙字典体"))).distinct(),
    }


def nyukan(spark: SparkSession, variants: Sequence[Sequence[str]], similar: Sequence[Sequence[str]]) -> DataFrame:
    """The immigration lists: code, first and perhaps second standard code. Private-use codes have no character."""
    rows = [(kind, r[0], code, k) for kind, t in (("異体字", variants), ("類字", similar)) for r in t for k, code in enumerate(r[1:3], 1) if code]
    df = spark.createDataFrame(rows, "`正字の種類` string, a string, b string, `順位` int")
    char = lambda c: F.when(~F.conv(c, 16, 10).cast("int").between(0xE000, 0xF8FF), X.hex_char(c))
    return df.select("正字の種類", F.col("a").alias("簡体字等の文字コード等"), char("a").alias("簡体字等のUCS"), F.col("b").alias("正字の文字コード等"), char("b").alias("正字のUCS"), "順位")


def tabbed(spark: SparkSession, path: str, names: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """A tab-separated file whose first line is a header, under given names; empty cells are null."""
    raw = spark.read.schema(text_schema(names)).csv(path, sep="\t", header=True, quote="", enforceSchema=True)
    return raw.select(*((F.col(n).try_cast("int") if n in numbers else F.nullif(n, F.lit(""))).alias(n) for n in names))


DOON = ("書きかえる漢字", "書きかえた漢字", "書きかえる漢語", "書きかえた漢語", "採用した文書")
TGHB = ("序号", "规范字", "级", "笔画", "註解")
TGHB_VARIANTS = ("序号", "规范字", "繁体字", "异体字", "註解")


def kdpv(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """kdpv (subject, rel, object, comment) and kdpv_rels (rel, name, rev, rev_name) of comma files, with
    <name> and <rev> rows about relations; and of the tab-separated file of old and new Japanese forms."""
    rows, facts = None, None
    for path in paths:
        if path.endswith("jp-old-style.txt"):
            f = lines(spark, path).select(*(F.trim(c) for c in fields("\t", ("subject", "a", "b", "c")))).toDF("subject", "a", "b", "c")
            pair = F.explode(F.array(F.struct(F.lit("jp/old-style").alias("rel"), F.col("a").alias("object")), F.struct(F.lit("jp/old-style/compat").alias("rel"), F.col("b").alias("object")))).alias("p")
            own = f.select("subject", pair, F.regexp_replace("c", r"^#\s*", "").alias("comment")).select("subject", "p.rel", "p.object", F.nullif("comment", F.lit("")).alias("comment")).where("object <> ''")
            told = spark.createDataFrame([("jp/old-style", "<rev>", "jp/new-style"), ("jp/old-style/compat", "<rev>", "jp/new-style"), ("jp/old-style", "<name>", "旧字体"), ("jp/new-style", "<name>", "新字体"), ("jp/old-style/compat", "<name>", "旧字体（互換漢字）")], "subject string, rel string, object string")
        else:
            f = lines(spark, path).select(*(F.trim(c) for c in fields(",", ("subject", "rel", "object", "comment")))).toDF("subject", "rel", "object", "comment")
            own = f.where(~F.col("rel").startswith("<"))
            told = f.where(F.col("rel").isin("<name>", "<rev>")).select("subject", "rel", "object")
            told = told.union(told.where("rel = '<rev>'").select("object", "rel", "subject"))
        rows = own if rows is None else rows.unionByName(own)
        facts = told if facts is None else facts.union(told)
    fact = facts.groupBy("subject").agg(F.max(F.when(F.col("rel") == "<name>", F.col("object"))).alias("name"), F.max(F.when(F.col("rel") == "<rev>", F.col("object"))).alias("rev"))
    rels = rows.select("rel").distinct().join(fact.withColumnRenamed("subject", "rel"), "rel", "left")
    rels = rels.join(fact.select(F.col("subject").alias("rev"), F.col("name").alias("rev_name")), "rev", "left").select("rel", "name", "rev", "rev_name")
    return {"kdpv": rows, "kdpv_rels": rels}


# ------------------------------------------------------------- sinks


def write_tables(tables: dict[str, DataFrame], folder: str, keys: dict[str, str] | None = None, by_value: dict[str, str] | None = None) -> dict:
    """Each table as Parquet, sorted by its key so that key ranges skip row groups, or in a folder for each
    value of a column; returns a manifest of rows and schemas."""
    manifest = {}
    for name, df in tables.items():
        out = df
        if key := (keys or {}).get(name):
            out = df.repartitionByRange(key).sortWithinPartitions(key)
        writer = out.write.mode("overwrite")
        if column := (by_value or {}).get(name):
            writer = writer.partitionBy(column)
        writer.parquet(f"{folder}/{name}")
        back = df.sparkSession.read.parquet(f"{folder}/{name}")
        manifest[name] = {"rows": back.count(), "schema": df.schema.simpleString()}
    return manifest


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def checksums(spark: SparkSession, folder: str, names: Iterable[str]) -> DataFrame:
    """(name, file, bytes, sha256) of the files of stored tables, read where they lie."""
    out = None
    for n in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/{n}")
        own = files.select(F.lit(n).alias("name"), F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = own if out is None else out.unionByName(own)
    return out


def quoted(c: str, kind: str) -> Column:
    """A column's values as SQL literals; control characters and such stand as they are."""
    value = F.col(f"`{c}`")
    text = value.cast("string") if kind in ("tinyint", "smallint", "int", "bigint", "double", "float", "boolean") or kind.startswith("decimal") else F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def export_sql(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as a folder of text files with an INSERT statement a line, views as the rows that they give, and
    checksums of all files. Arrays and such are written as JSON; line ends in texts as char(10) and char(13)."""
    for name, df in tables.items():
        flat = df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema))
        values = F.concat_ws(", ", *(quoted(c, t) for c, t in flat.dtypes))
        for char, code in (("\n", 10), ("\r", 13)):
            values = F.replace(values, F.lit(char), F.lit(f"' || char({code}) || '"))
        columns = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
        flat.select(F.concat(F.lit(f'INSERT INTO "{name}" ({columns}) VALUES ('), values, F.lit(");")).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return checksums(spark, folder, tables)


def postings(structures: DataFrame) -> DataFrame:
    """(token, docid, pos): where each token of each character's document stands; docid is the character."""
    from ..operators.structures import index_tables

    return index_tables(structures)["postings"]


def needs_rebuild(inputs: dict[str, bytes], stamp: str | None) -> tuple[bool, str]:
    """Whether the inputs differ from those of a stamp, and their own stamp."""
    h = hashlib.sha256()
    for name in sorted(inputs):
        h.update(f"{name}\0{hashlib.sha256(inputs[name]).hexdigest()}\n".encode())
    return h.hexdigest() != stamp, h.hexdigest()


