"""Views, searches and decompositions of a few characters, with results written out."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import exprs as X
from glyphmill.operators import derived as D
from glyphmill.operators import documents, graph
from glyphmill.operators import structures as S
from glyphmill.operators.properties import character_registry
from glyphmill.plans import bindings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_views(spark):
    han = bindings.han(spark)
    assert rows(D.unihan_variant(han)) == sorted(
        [("线", "kTraditionalVariant", "線", None), ("说", "kSemanticVariant", "說", "kMatthews"), ("说", "kSemanticVariant", "説", "kFenn:T"), ("乗", "kJoyoKanji", "乗", None), ("亘", "kJinmeiyoKanji", "亙", None)], key=str
    )
    assert rows(D.unihan_strange(han)) == sorted([("丂", "A", None), ("丂", "B", "一"), ("丂", "B", "𠀀"), ("丂", "I", None)], key=str)
    assert rows(D.unihan_source(han)) == [("一", "G", "G0-523B")]
    want = [("線", "线", "kTraditionalVariant"), ("說", "说", "kSemanticVariant"), ("説", "说", "kSemanticVariant"), ("乗", "乗", "kJoyoKanji"), ("亙", "亘", "kJinmeiyoKanji"), ("一", "丂", "kStrange"), ("𠀀", "丂", "kStrange"), ("壱", "一", "kDefinition")]
    assert rows(D.unihan_value_ref(han).select("ref", "UCS", "property")) == sorted(want, key=str)
    assert rows(D.unihan_each(han, ["kTotalStrokes"])) == sorted([("漢", "kTotalStrokes", 1, "14"), ("漢", "kTotalStrokes", 2, "13"), ("一", "kTotalStrokes", 1, "1")], key=str)


def test_numbers_and_codes(spark):
    t = spark.createDataFrame([(x,) for x in ("12 11", "", "abc", "-2x", " 5", "0x1F")], "u string")
    assert {r.u: (r.n, r.p) for r in t.select("u", X.leading_int("u").alias("n"), X.parse_int("u").alias("p")).collect()} == {"12 11": (12, 12), "": (0, None), "abc": (0, None), "-2x": (-2, -2), " 5": (5, 5), "0x1F": (0, 0)}
    c = spark.range(1).select(F.lit("4E00_E0100").alias("code")).withColumn("chars", X.sequence_char("code"))
    assert rows(c.select("code", "chars", X.u_plus("chars"), X.sequence_name("chars", " "))) == [("4E00_E0100", "一\U000e0100", "U+4E00", "4E00 E0100")]
    assert rows(D.split_rows(spark.range(1).select(F.lit("a漢𠮷é").alias("t")), "t", "", "value", "i").select("i", "value")) == [(1, "a"), (2, "漢"), (3, "𠮷"), (4, "é")]


# Patterns and what they find; U stands for the character without a code point.
CASES = {
    "⿰火土": "灶", "§？§": "XU信囚工明林森武江灶申萌蒜", "§⿰？土§": "灶", "？": "", "⿻丨日": "申", "⿻日丨": "申", "§⿱x⿰xx§": "森", "木*2": "林森", "木*3": "森", "§⿱艹⿰日月§": "萌", "日": "明申萌", "工": "工江", "火": "X灶",
}


@pytest.fixture(scope="module")
def structures(spark):
    return S.decompose_table(bindings.trees(spark)).persist()


@pytest.mark.parametrize("pattern", CASES)
def test_structure_search(spark, structures, pattern):
    assert {r.UCS for r in S.search(structures, [pattern]).collect()} == {"&U1;" if c == "U" else c for c in CASES[pattern]}


def test_full_decomposition(structures):
    assert rows(structures) == sorted(bindings._FULL.items(), key=str)


def test_projections(spark):
    want = {"@R ⿲ a b c": "c", "@T ⿱ ⿰ x y z": "⿰ x y", "@I ⿴ 囗 人": "人", "@L @R ⿰ a ⿲ b c d": "b", "@M ⿰ a b": None, "@L": None}
    t = spark.createDataFrame([(x,) for x in (*want, None)], "t string")
    assert {r.t: r.p for r in S.project_table(t, "t", "p").collect()} == want | {None: None}


def test_variants_by_their_labels(spark):
    e = spark.createDataFrame([("A", "B", "strong-ab"), ("A", "X", "cjkvi/non-cognate"), ("B", "C", "strong-bc"), ("C", "Y", "kStrange_I"), ("Y", "Z", "strong"), ("A", None, "dropped")], "c1 string, c2 string, r string")
    want = [("A", "B", "strong-ab", 1), ("A", "X", "cjkvi/non-cognate", 0), ("B", "C", "strong-bc", 1), ("C", "Y", "kStrange_I", 0)]
    assert rows(graph.variants(e.dropna(), ["A"])) == want


def test_character_keys(spark):
    t = bindings.full_catalog(spark)
    assert [r.r for r in character_registry().search(t, ["totalStrokes.ge", "unihan.kMorohashi.has", "mji.読み.prefix"], ["13", "", "カ"]).collect()] == ["漢"]
    more = [("弐", "kAccountingNumeric", "2"), ("五", "kPrimaryNumeric", "5"), ("一", "kPrimaryNumeric", "1")]
    t = D.with_views({n: x for n, x in t.items() if not n.startswith("unihan")} | {"unihan": t["unihan"].union(spark.createDataFrame(more, "UCS string, property string, value string"))})
    for key, q, want in (
        ("UCS", "U+6F22", "漢"), ("totalStrokes", "14", "漢"), ("totalStrokes.lt", "2", "一"), ("unihan.kAccountingNumeric.ge", "2", "弐"), ("unihan.kPrimaryNumeric", "5", "五"), ("unihan.kTraditionalVariant", "線", "线"),
        ("unihan.kTraditionalVariant", "U+7DDA", "线"), ("unihan.kStrange", "一", "丂"), ("unihan.kStrange.B", "一", "丂"), ("unihan.kStrange.A.has", "", "丂"),
    ):
        assert {r.r for r in character_registry().find(t, key, q).collect()} == {want}, key


DOCUMENTS = {
    "漢": '{"char":"漢","UCS":"U+6F22","ids":[{"IDS":"⿰氵𦰩","source":"G"}],"ids_comment":["x"],"ivs":[],"joyo_kangxi":[],"kdpv":{},"unihan_rs":{"kRSAdobe_Japan1_6":[[85,10,"水",3,"CID+1533"]],"kRSUnicode":[[85,11,"水","85"]]}}',
    "一": '{"char":"一","UCS":"U+4E00","ids":[],"ids_comment":[],"ivs":[{"char":"一\U000e0100","IVS":"4E00_E0100","collection":"ExampleCollection","code":"CID+1200"},{"char":"一\U000e0101","IVS":"4E00_E0101","collection":"ExampleCollection","code":"CID+1200"}],"joyo_kangxi":[],"kdpv":{"cjkvi/duplicate":["壱"],"jp/new-style":["弌"]},"unihan_rs":{"kRSAdobe_Japan1_6":null,"kRSUnicode":null}}',
}


def test_character_documents(spark):
    chars = spark.createDataFrame([(c,) for c in DOCUMENTS], "char string")
    got = documents.character_documents(bindings.catalog(spark), chars, ["UCS", "char", "ids", "ids_comment", "ivs", "kdpv", "joyo_kangxi", "unihan_rs"])
    assert {r.char: r.document for r in got.collect()} == DOCUMENTS


PAGES = [
    ({"ids": ["日"]}, "明申萌"), ({"ids": ["日"], "limit": "2", "offset": 1}, "申萌"), ({"whole": ["⿰日月"]}, "明"), ({"ids": ["日"], "p": ["unihan.kTotalStrokes.ge"], "q": ["9"]}, "萌"),
    ({"p": ["unihan.kTotalStrokes"], "q": ["8"]}, "明"), ({"ids": ["§？§"], "limit": 2}, "X信"), ({"ids": ["§？§"], "limit": 2, "all_results": True}, "UX"), ({"ids": ["⿻丨日"]}, "申"), ({"ids": ["日", "月"]}, "明萌"),
]


def test_pages_of_loaded_and_stored_catalogs(spark, structures, tmp_path):
    from glyphmill.plans.engine import Engine, build

    t = dict(bindings.full_catalog(spark))
    t["unihan"] = t["unihan"].union(spark.createDataFrame([("明", "kTotalStrokes", "8"), ("萌", "kTotalStrokes", "11")], "UCS string, property string, value string"))
    t["ids"] = bindings.trees(spark)
    stored = build({n: t[n] for n in ("ids", "unihan")}, f"file://{tmp_path}/catalog")
    for engine in (Engine(spark, t | {"structures": structures}), Engine(spark, stored)):
        for args, want in PAGES:
            found = engine.find(**args)
            assert [r.r for r in found["results"].collect()] == ["&U1;" if c == "U" else c for c in want], args
            assert found.get("total", len(want)) == len(want) and ("done" in found) == ("limit" in args)


@pytest.mark.parametrize("name", bindings._FIELDS)
def test_document_fields(spark, name):
    d = documents.character_documents(bindings.full_catalog(spark), spark.createDataFrame([("漢",)], "char string"), [name])
    assert [r.document for r in d.collect()] == [f'{{"{name}":{bindings._FIELDS[name]}}}']


def test_similar_characters(spark):
    d = documents.character_documents(bindings.catalog(spark), spark.createDataFrame([("卍",)], "char string"), ["ids_similar"])
    assert [r.document for r in d.collect()] == ['{"ids_similar":[{"UCS":"卐","IDS":"⿾卍","source":"GT"}]}']


def test_variant_map(spark):
    unihan = spark.createDataFrame([("漢", "kZVariant", "U+6C49")], "UCS string, property string, value string")
    kdpv = spark.createDataFrame([("王", "cjkvi/radical-variant", "王", None), ("水", "cjkvi/radical-variant", "氵", None), ("火", "cjkvi/radical-variant", "灬", "partial")], "subject string, rel string, object string, comment string")
    assert S.variant_map(unihan, kdpv) == {"漢": ["漢", "汉"], "氵": ["水"]}


# fmt: off
EDGES = [
    ("线", "線", "kTraditionalVariant"), ("说", "說", "kSemanticVariant"), ("说", "説", "kSemanticVariant"), ("乗", "乗", "kJoyoKanji"), ("亘", "亙", "kJinmeiyoKanji"), ("漢", "汉", "辞書類等による関連字"),
    ("漢", "汉", "入管正字_類字_第1順位"), ("漢", "汗", "同音の漢字による書きかえ"), ("乘", "乗", "常用漢字表_新字体"), ("\ufa47", "漢", "常用漢字表_新字体"), ("一", "壱", "cjkvi/duplicate"),
    ("熯", "漢", "tghb_异体字"), ("漢", "汉", "tghb_规范字"), ("漢", "汉", "tghb_规范字"),
]
# fmt: on


def test_edges(spark):
    assert rows(graph.edges(bindings.full_catalog(spark))) == sorted(EDGES, key=str)
