"""Property search: named keys that give sets of characters, and their algebra.

A key names a field and an operation, `field.op`; a query pairs keys with values. Each positive key gives
the set of characters (one column, `r`) for which it holds. `.eq` is the field's own key where there is
one; `.ne`, `.notHas` and `.notGlob` are complements, over the universe of all characters with a
structure, of the key itself, of `.has` and of `.glob`. A search is the intersection of its keys' sets.

A field is declared once, with the table, the column of characters, the column of values, a filter, and a
kind that says how values compare; every key of the field follows from the kind. All sets are DataFrame
plans, so filters reach the scans and sets meet as semi and anti joins on `r`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import bitmaps

Catalog = Mapping[str, DataFrame]
RANGES: dict[str, Callable[[Column, Column], Column]] = {
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


class UnknownKey(ValueError):
    pass


def literal_code(q: str) -> str | None:
    """The character of a hexadecimal code with or without U+ in front, if it is one that can be looked up:
    a letter, number or symbol."""
    m = re.fullmatch(r"(?:U\+)?([0-9A-Fa-f]{1,6})", q.strip())
    if not m or not (n := int(m[1], 16)) <= 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        return None
    return chr(n) if unicodedata.category(chr(n))[0] in "LNS" else None


def code_or_self(q: str) -> str:
    """The character of a code, or the text itself."""
    m = re.fullmatch(r"(?:U\+)?([0-9A-Fa-f]{1,6})", q.strip())
    if m and int(m[1], 16) <= 0x10FFFF and not 0xD800 <= int(m[1], 16) <= 0xDFFF:
        return chr(int(m[1], 16))
    return q


@dataclass(frozen=True)
class Field:
    """kind: `text` (whole value), `variant` (value or code), `token` (a part of the value or code),
    `number` (a number column), `textnumber` (the number a text begins with). only: what a row must have.
    ops: the operations besides the plain one."""

    name: str
    table: str
    value: str
    kind: str
    char: str = "UCS"
    only: Callable[[], Column] | None = None
    ops: Sequence[str] = ("has",)
    more: Mapping[str, str] = field(default_factory=dict)

    def rows(self, tables: Catalog) -> DataFrame:
        df = tables[self.table]
        return df.where(self.only()) if self.only else df

    def test(self, op: str, q: str, v: Column | None = None) -> Column:
        """Whether a value (else that of the field's column) meets the operation."""
        v = F.col(self.value) if v is None else v
        if op == "has":
            return v.isNotNull() if self.kind != "category" else F.lit(True)
        if op == "glob":
            return X.glob(F.coalesce(v, F.lit("")) if self.kind == "category" else v, q)
        if op == "prefix":
            return X.glob(v, q.replace("*", "") + "*")
        if op in RANGES or self.kind in ("number", "textnumber"):
            left = X.leading_int(v) if self.kind in ("textnumber", "token") else v
            return RANGES.get(op, lambda a, b: a == b)(left, X.leading_int(F.lit(q)))
        if self.kind in ("variant", "category"):
            return v.isin(*{q, code_or_self(q)})
        if self.kind == "token":
            # a code stands for the whole value only
            return X.has_token(v, q) | (v == F.lit(code_or_self(q)))
        return v == F.lit(q)

    def keys(self) -> dict[str, Callable[[Catalog, str], DataFrame]]:
        def find(op: str):
            return lambda tables, q: self.rows(tables).where(self.test(op, q)).select(F.col(self.char).alias("r")).where("r is not null").distinct()

        return {self.name: find("")} | {f"{self.name}.{op}": find(op) for op in self.ops}


def union_keys(name: str, a: str, b: str, ops: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Keys that are the union of two fields' keys of the same operation."""
    return {name + s: (a + s, b + s) for s in ["", *(f".{op}" for op in ops)]}


class Registry:
    """All positive keys, and what searches make of them. universe: table and column of all characters."""

    def __init__(self, fields: Sequence[Field], universe: tuple[str, str] = ("ids", "UCS"), unions: Mapping[str, tuple[str, str]] | None = None, code_key: str | None = "UCS"):
        self.keys: dict[str, Callable[[Catalog, str], DataFrame]] = {}
        self.fields = {f.name: f for f in fields}
        self.universe_at = universe
        if code_key:
            self.keys[code_key] = self._code
        for f in fields:
            self.keys |= f.keys()
        for name, (a, b) in (unions or {}).items():
            self.keys[name] = lambda tables, q, a=a, b=b: self.keys[a](tables, q).union(self.keys[b](tables, q)).distinct()

    def _code(self, tables: Catalog, q: str) -> DataFrame:
        c = literal_code(q)
        spark = next(iter(tables.values())).sparkSession
        return spark.range(1 if c else 0).select(F.lit(c).cast("string").alias("r"))

    def universe(self, tables: Catalog) -> DataFrame:
        table, c = self.universe_at
        return tables[table].select(F.col(c).alias("r")).where("r is not null").distinct()

    def positive(self, key: str) -> Callable[[Catalog, str], DataFrame]:
        if key.endswith(".eq") and key[:-3] in self.keys:
            key = key[:-3]
        if key not in self.keys:
            raise UnknownKey(f"Unknown query key: {key}")
        return self.keys[key]

    def resolve(self, key: str) -> tuple[Callable[[Catalog, str], DataFrame], bool]:
        """The positive key behind a key, and whether its complement is asked for."""
        for end, base in ((".notHas", ".has"), (".notGlob", ".glob"), (".ne", "")):
            if key.endswith(end):
                return self.positive(key[: -len(end)] + base), True
        return self.positive(key), False

    def find(self, tables: Catalog, key: str, q: str) -> DataFrame:
        made, no = self.resolve(key)
        out = made(tables, q)
        return self.universe(tables).join(out, "r", "left_anti") if no else out

    def search(self, tables: Catalog, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
        """Characters for which all keys hold, in order."""
        if not keys or len(keys) != len(values):
            raise ValueError("as many values as keys, one at least, are needed")
        sets = [self.find(tables, k, q) for k, q in zip(keys, values, strict=True)]
        out = sets[0]
        for s in sets[1:]:
            out = out.join(s, "r", "left_semi")
        return out.orderBy("r")

    def bitmaps(self, tables: Catalog) -> tuple[DataFrame, DataFrame]:
        """The universe's dense numbers, and the bitmaps of all fields' values, for `search_bitmaps`."""
        numbers = bitmaps.dense_numbers(self.universe(tables))
        return numbers, bitmaps.bitmaps(numbers, {n: f.rows(tables).select(F.col(f.char).alias("r"), F.col(f.value).alias("value")) for n, f in self.fields.items()})

    def condition(self, key: str, q: str) -> bitmaps.Condition:
        """A key's field, the test of its values as text, and whether the complement is asked for."""
        no = next(((end, base) for end, base in (("notHas", "has"), ("notGlob", "glob"), ("ne", "")) if key.endswith(f".{end}")), None)
        bare = key[: -len(no[0]) - 1] + (no[1] and f".{no[1]}") if no else key
        bare = bare[:-3] if bare.endswith(".eq") and bare[:-3] in self.keys else bare
        name, _, op = (bare, "", "") if bare in self.fields else bare.rpartition(".")
        if name not in self.fields or (op and op not in self.fields[name].ops):
            raise UnknownKey(f"Unknown query key: {key}")
        f = self.fields[name]
        return name, lambda v: f.test(op, q, v.try_cast("double") if f.kind == "number" else v), no is not None

    def search_bitmaps(self, numbers: DataFrame, maps: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
        """As `search`, of the universe's members, from bitmaps: one read of the keys' bitmaps, whatever their number."""
        if not keys or len(keys) != len(values):
            raise ValueError("as many values as keys, one at least, are needed")
        return bitmaps.members(numbers, bitmaps.combine(maps, [self.condition(k, q) for k, q in zip(keys, values, strict=True)])).orderBy("r")

    def filter_chars(self, chars: DataFrame, tables: Catalog, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
        """Rows of (pos, r) for which all keys hold; order and repeats stay."""
        for k, q in zip(keys, values, strict=True):
            chars = chars.join(self.find(tables, k, q), "r", "left_semi")
        return chars.select("pos", "r").orderBy("pos")


def listed(spark: SparkSession, chars: Sequence[str]) -> DataFrame:
    """A sequence as rows of (pos, r)."""
    return spark.createDataFrame(list(enumerate(chars)), "pos long, r string")


def page(found: DataFrame, limit: str | int | None = None, offset: str | int | None = None) -> tuple[DataFrame, bool]:
    """The part of an ordered set that paging asks for, and whether paging applies. Whole numbers over 0
    count, also at the beginning of a text; anything else is no limit or offset."""

    def number(x: str | int | None) -> int:
        m = re.match(r"\s*\+?(\d+)", str(x if x is not None else ""))
        return int(m[1]) if m else 0

    n, skip = number(limit), number(offset)
    out = found.orderBy("r")
    if skip:
        out = out.offset(skip)
    if n:
        out = out.limit(n)
    return out, bool(n or skip)


# ------------------------------------------------------------- the character fields

# Property names of the Unicode Han database, by how they are searched.
VARIANTS = "kCompatibilityVariant kSemanticVariant kSimplifiedVariant kSpecializedSemanticVariant kSpoofingVariant kTraditionalVariant kZVariant".split()
DICTIONARIES = "kHanYu kIRGHanyuDaZidian kIRGKangXi kKangXi kCihaiT kSBGY kNelson kCowles kMatthews kGSR kFennIndex kKarlgren kMeyerWempe kLau kCheungBauerIndex kMorohashi kDaeJaweon kIRGDaeJaweon kSMSZD2003Index".split()
INDEXES = "kCheungBauer kFenn kFourCornerCode kCangjie kPhonetic kRSAdobe_Japan1_6 kHDZRadBreak kIRGDaiKanwaZiten".split()
NUMERIC = "kAccountingNumeric kOtherNumeric kPrimaryNumeric kTayNumeric kVietnameseNumeric kZhuangNumeric".split()
OTHERS = (
    "kIICore kAlternateTotalStrokes kBigFive kCCCII kCNS1986 kCNS1992 kIRG_GSource kIRG_HSource kIRG_JSource kIRG_KPSource kIRG_KSource kIRG_MSource "
    "kIRG_SSource kIRG_TSource kIRG_UKSource kIRG_USource kIRG_VSource kRSUnicode kEACC kGB0 kGB1 kGB3 kGB5 kGB8 kGradeLevel kHKGlyph kIBMJapan "
    "kJIS0213 kJis0 kJis1 kKoreanEducationHanja kKoreanName kMainlandTelegraph kMojiJoho kPseudoGB1 kTGH kTaiwanTelegraph kUnihanCore2020 kXerox "
    "kCantonese kDefinition kFanqie kHangul kHanyuPinlu kHanyuPinyin kJapanese kJapaneseKun kJapaneseOn kKorean kMandarin kSMSZD2003Readings kTang "
    "kTGHZ2013 kVietnamese kXHC1983 kZhuang"
).split()
STRANGE = "A B C H I K M O R S U Y".split()


def _property(name: str) -> Callable[[], Column]:
    return lambda: F.col("property") == name


def _category(name: str) -> Callable[[], Column]:
    return lambda: F.col("category") == name


def _known() -> Column:
    return F.col("対応するUCS").isNotNull()


def character_fields() -> list[Field]:
    compare = tuple(RANGES)
    return [
        Field("mji.読み", "mji_by_reading", "読み", "text", "対応するUCS", _known, ("prefix", "glob", "has")),
        Field("mji.総画数", "mji", "総画数", "number", "対応するUCS", _known, (*compare, "has")),
        Field("mji.MJ文字図形名", "mji", "MJ文字図形名", "text", "対応するUCS", _known, ("has",)),
        Field("unihan.kTotalStrokes", "unihan", "value", "textnumber", only=_property("kTotalStrokes"), ops=(*compare, "has")),
        *(Field(f"unihan.{p}", "unihan_variant", "value", "variant", only=_property(p), ops=("glob", "has")) for p in VARIANTS),
        *(Field(f"unihan.{p}", "unihan", "value", "token", only=_property(p), ops=("glob", "has")) for p in (*DICTIONARIES, *INDEXES, *OTHERS)),
        *(Field(f"unihan.{p}", "unihan", "value", "token", only=_property(p), ops=("glob", "has", *compare)) for p in NUMERIC),
        *(Field(f"unihan.kStrange.{c}", "unihan_strange", "value", "category", only=_category(c), ops=("glob", "has")) for c in STRANGE),
        Field("unihan.kStrange", "unihan_strange", "value", "category", ops=("glob", "has")),
    ]


def character_registry() -> Registry:
    return Registry(character_fields(), unions=union_keys("totalStrokes", "unihan.kTotalStrokes", "mji.総画数", (*RANGES, "has")))
