"""Tables that follow from loaded ones: split, unpivoted, laid over, referenced in reverse, merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def split_rows(df: DataFrame, c: str, mark: str, name: str = "value", place: str | None = None) -> DataFrame:
    """A row per part of a column; place: also its number from 1."""
    parts = df.withColumn("_p", F.explode(X.split_with_index(c, mark)))
    keep = [x for x in df.columns if x != c]
    return parts.select(*keep, *([F.col("_p.i").alias(place)] if place else []), F.col("_p.value").alias(name))


def join_rows(df: DataFrame, key: str, place: str = "i", value: str = "value", mark: str = " ") -> DataFrame:
    """The inverse: parts in order of their places in one text."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]), mark).alias(value))


def unpivot_groups(df: DataFrame, keys: Sequence[str], groups: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """A row per group of columns that are all there."""
    each = F.explode(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(g, names, strict=True))) for g in groups))).alias("_g")
    return df.select(*keys, each).select(*keys, *(f"_g.{n}" for n in names)).dropna(subset=list(names))


def expand_range(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def overlay(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union where a key's rows in a later table replace all its rows in earlier ones."""
    every = None
    for k, p in enumerate(parts):
        own = p.withColumn("_part", F.lit(k))
        every = own if every is None else every.unionByName(own)
    last = every.groupBy(key).agg(F.max("_part").alias("_part"))
    return every.join(last, [key, "_part"], "left_semi").drop("_part")


def tagged_union(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of tables with their names in a column; missing columns are null."""
    out = None
    for name, p in parts.items():
        own = p.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def merge_flags(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """A row per key with, for each table, how many rows it has there."""
    names = list(parts)
    units = tagged_union({n: p.select(*keys) for n, p in parts.items()}, "_of")
    return units.groupBy(*keys).agg(*(F.sum((F.col("_of") == n).cast("int")).alias(n) for n in names))


def first_match(values: Column, test: Column) -> Column:
    """The place from 1 of the first value for which the boolean array `test` holds; null without one."""
    at = F.array_position(test, True)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows a key in each task before it moves any."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def first_value(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str | None = None) -> DataFrame:
    """Each key's value in its first row, by aggregation: no group is sorted or gathered."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(name or value))


#: Parts of equal width that a band of values is counted in before what is left is sorted.
BAND_PARTS = 4096


def nearest_ranks(rows: DataFrame, key: str, value: str, shares: Mapping[str, float], accuracy: int = 1000) -> DataFrame:
    """Per key, the exact value of nearest rank for each named share, and n (values that aren't null). An approximate
    percentile bounds a band around each rank; the band is counted in parts of equal width, and only the values of the part that holds
    the rank are sorted, the others are counted. So of a key with very many values one task sorts those of a part of a band."""
    names = list(shares)
    rows = rows.where(F.col(value).isNotNull()).select(key, value)
    ends = [min(max(s + d, 0.0), 1.0) for s in shares.values() for d in (-2.0 / accuracy, 2.0 / accuracy)]
    about = rows.groupBy(key).agg(F.percentile_approx(value, ends, accuracy * 10).alias("_ends"), F.count("*").alias("n"))
    bands = F.array(*(F.struct(F.lit(name).alias("name"), F.get("_ends", F.lit(2 * k)).alias("lo"), F.get("_ends", F.lit(2 * k + 1)).alias("hi"), F.greatest(F.ceil(F.lit(s) * F.col("n")), F.lit(1)).alias("rank")) for k, (name, s) in enumerate(shares.items())))
    about = about.select(key, "n", F.explode(bands).alias("_b")).select(key, "n", "_b.*")
    met = rows.join(about, key).where(F.col(value) <= F.col("hi"))
    # rises with the value, and is one number where the ends give no width
    at = (F.col(value).cast("double") - F.col("lo").cast("double")) / F.nullif(F.col("hi").cast("double") - F.col("lo").cast("double"), F.lit(0.0))
    part = F.when(F.col(value) < F.col("lo"), -1).otherwise(F.floor(F.greatest(F.least(F.nanvl(F.coalesce(at, F.lit(0.0)), F.lit(1.0)), F.lit(1.0)), F.lit(0.0)) * BAND_PARTS))
    counted = met.groupBy(key, "name", part.cast("int").alias("_part")).agg(F.count("*").alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    upto = lambda by: F.sum("c").over(Window.partitionBy(key, "name").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    held = counted.withColumn("_upto", upto("_part")).where("_upto >= rank and _upto - c < rank")
    held = held.select(key, "name", "lo", "hi", (F.col("rank") - F.col("_upto") + F.col("c")).alias("rank"), "n")
    inside = rows.join(held, key).where(F.col(value).between(F.col("lo"), F.col("hi")))
    each = inside.groupBy(key, "name", F.col(value).alias("v")).agg(F.count("*").alias("c"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    found = each.withColumn("_upto", upto("v")).where("_upto >= rank")
    return found.groupBy(key).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names), F.max("n").alias("n"))


def pairs_of(rows: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of the same key with other values: (key columns, a, b), either way round."""
    a, b = names
    return rows.select(*keys, F.col(value).alias(a)).join(rows.select(*keys, F.col(value).alias(b)), list(keys)).where(F.col(a) != F.col(b))


# Variant properties of the Unicode Han database.
VARIANT_PROPERTIES = ("kCompatibilityVariant", "kSemanticVariant", "kSimplifiedVariant", "kSpecializedSemanticVariant", "kSpoofingVariant", "kTraditionalVariant", "kZVariant", "kJoyoKanji", "kJinmeiyoKanji")
#: Values of these refer to no characters.
NO_REFERENCES = ("kJapanese", "kSMSZD2003Readings", "kFanqie")


def unihan_variant(unihan: DataFrame) -> DataFrame:
    """(UCS, property, value, additional_data): the characters that variant properties name, with notes."""
    p, v = F.col("property"), F.col("value")
    rows = unihan.where(p.isin(*VARIANT_PROPERTIES) & ((p != "kJoyoKanji") | v.startswith("U+")) & ((p != "kJinmeiyoKanji") | v.rlike(r"(?s)\A20..:U\+")))
    each = rows.select("UCS", "property", F.explode(F.split(F.when(p == "kJinmeiyoKanji", F.substring(v, 6, 10**6)).otherwise(v), " ")).alias("e"))
    note = F.when(F.contains("e", F.lit("<")), F.substring("e", F.instr("e", "<") + 1, F.lit(10**6)))
    return each.select("UCS", "property", X.hex_char(F.substring(F.split_part("e", F.lit("<"), F.lit(1)), 3, 8)).alias("value"), note.alias("additional_data"))


def unihan_strange(unihan: DataFrame) -> DataFrame:
    """(UCS, category, value) of kStrange entries `C` or `C:v:v`; a category without values has a null one."""
    e = unihan.where("property = 'kStrange'").select("UCS", F.explode(F.split("value", " ")).alias("e"))
    parts = F.filter(F.split(F.substring("e", 3, 10**6), ":"), lambda x: x != "")
    v = e.select("UCS", F.substring("e", 1, 1).alias("category"), F.explode_outer(parts).alias("v"))
    return v.select("UCS", "category", F.coalesce(F.when(F.col("v").startswith("U+"), X.hex_char(F.substring("v", 3, 8))), F.col("v")).alias("value"))


def unihan_source(unihan: DataFrame) -> DataFrame:
    s = F.regexp_extract("property", r"^kIRG_(\w+?)Source$", 1)
    return unihan.where(s != "").select("UCS", s.alias("source"), "value")


def unihan_each(unihan: DataFrame, properties: Sequence[str]) -> DataFrame:
    """(UCS, property, i, value): the parts of space-delimited properties, numbered from 1."""
    return split_rows(unihan.where(F.col("property").isin(*properties)), "value", " ", "value", "i").select("UCS", "property", "i", "value")


def value_references(c: Column | str) -> Column:
    """The characters that a text refers to, distinct: those over U+00FF in it and those it names U+XXXX."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.filter(F.split(c, ""), lambda x: F.ascii(x) > 0xFF)
    named = F.transform(F.regexp_extract_all(c, F.lit(r"U\+([0-9A-F]{4,6})(?![0-9A-F])"), F.lit(1)), X.hex_char)
    return F.array_distinct(F.concat(plain, F.filter(named, lambda x: x.isNotNull() & (F.ascii(x) > 0xFF))))


def unihan_value_ref(unihan: DataFrame) -> DataFrame:
    """(ref, UCS, property, value): the reverse index of references, sorted by ref where it is written."""
    rows = unihan.where(~F.col("property").isin(*NO_REFERENCES))
    return rows.select(F.explode(value_references("value")).alias("ref"), "UCS", "property", "value")


def with_views(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Loaded tables with those that follow from them."""
    out = dict(tables)
    if "unihan" in out:
        u = out["unihan"]
        for name, made in (("unihan_variant", unihan_variant), ("unihan_strange", unihan_strange), ("unihan_source", unihan_source), ("unihan_value_ref", unihan_value_ref)):
            out.setdefault(name, made(u))
    if "mji" in out and "mji_reading" in out:
        out.setdefault("mji_by_reading", out["mji"].select("MJ文字図形名", "対応するUCS").join(out["mji_reading"], "MJ文字図形名"))
    return out
