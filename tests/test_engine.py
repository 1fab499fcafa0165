"""The engine: expressions against SQLite, files, search keys, structures, documents, paging."""

import hashlib
import json
import math
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import exprs as X
from glyphmill.operators import derived as D
from glyphmill.operators import documents, graph
from glyphmill.operators import structures as S
from glyphmill.operators.properties import UnknownKey, character_registry, code_or_self, listed, literal_code, page
from glyphmill.plans import bindings
from glyphmill.plans.engine import BadRequest, Engine, decompose_text, joined_trees, parse_char
from glyphmill.sources import files
from tests import naive

LITE = sqlite3.connect(":memory:")


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?[]^-c]", max_size=7), st.text("abc]-^[*?", max_size=5))
def test_glob_is_sqlite_glob(pattern, text):
    import re

    want = bool(LITE.execute("select ? glob ?", (text, pattern)).fetchone()[0])
    java = X.glob_regex(pattern).replace(r"\z", r"\Z").replace("[^", "[^").replace(r"\&", "&")
    assert bool(re.search(java, text)) == want, (pattern, X.glob_regex(pattern))


def test_leading_int_is_sqlite_cast(spark):
    values = ["3 4", "", "abc", "-2x", " 7", "\t8", "+5", "- 5", "1e3", "99999999999", "０", "0x1F", "7.9", None, "--3"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(X.leading_int("v")).collect()]
    assert got == [LITE.execute("select cast(? as integer)", (v,)).fetchone()[0] for v in values]


def test_tokens_are_sqlite_globs(spark):
    values = ["a b", "b", "xb", "b a", "a b c", "ab c", "", None, "b*"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for q in ("b", "b*", "?", "a b", "[ab]"):
        got = [bool(r[0]) for r in df.select(X.has_token("v", q)).collect()]
        sql = "select ?1 = ?2 or ?1 glob ?2 || ' *' or ?1 glob '* ' || ?2 || ' *' or ?1 glob '* ' || ?2"
        assert got == [bool(LITE.execute(sql, (v, q)).fetchone()[0]) for v in values], q


def test_codes():
    assert (literal_code("6F22"), literal_code(" U+6f22 "), literal_code("u+6F22"), literal_code("漢"), literal_code("D800"), literal_code("20")) == ("漢", "漢", None, None, None, None)
    assert (code_or_self("4E00"), code_or_self("x y"), code_or_self("U+110000")) == ("一", "x y", "U+110000")


def test_registry_keys(spark):
    reg = character_registry()
    assert len(reg.keys) == 376
    for key in ("mji.総画数.lt.ne", "mji.読み.prefix.ne", "unihan.kMorohashi.eq.ne", "totalStrokes.ge", "unihan.kStrange.F"[:-1] + "B.notGlob", "unihan.kZVariant.notHas"):
        reg.resolve(key)
    for key in ("unihan.kMorohashi.lt", "unihan.kTotalStrokes.glob", "unihan.kStrange.F", "nothing", "x.ne", "mji.総画数.glob"):
        with pytest.raises(UnknownKey):
            reg.resolve(key)


def character_tables(spark):
    t = bindings.catalog(spark)
    mji = spark.createDataFrame([("MJ1", "漢", 13), ("MJ2", "一", 1), ("MJ3", None, 2)], "`MJ文字図形名` string, `対応するUCS` string, `総画数` long")
    reading = spark.createDataFrame([("MJ1", "カン"), ("MJ1", "から"), ("MJ2", "イチ")], "`MJ文字図形名` string, `読み` string")
    return D.with_views({**{k: v for k, v in t.items()}, "mji": mji, "mji_reading": reading})


def test_character_search(spark):
    t, reg = character_tables(spark), character_registry()
    find = lambda *kv: [r.r for r in reg.search(t, kv[::2], kv[1::2]).collect()]
    assert find("totalStrokes.ge", "13", "unihan.kMorohashi.has", "") == ["漢"]
    assert find("mji.読み.prefix", "カ") == ["漢"] and find("mji.読み", "イチ") == ["一"]
    assert find("unihan.kTotalStrokes", "14") == ["漢"] and find("unihan.kTotalStrokes.lt", "2") == ["一"]
    assert find("unihan.kTraditionalVariant", "7DDA") == find("unihan.kTraditionalVariant", "線") == ["线"]
    assert find("unihan.kStrange.B", "U+4E00") == ["丂"] and find("unihan.kStrange.A.has", "") == ["丂"]
    assert find("UCS", "U+6F22") == ["漢"] and find("UCS", "漢") == []
    assert find("unihan.kMorohashi.notHas", "") == sorted(["卐", "𠄏"])
    chars = reg.filter_chars(listed(spark, ["一", "漢", "x", "漢"]), t, ["unihan.kMorohashi.has"], [""])
    assert [(r.pos, r.r) for r in chars.collect()] == [(1, "漢"), (3, "漢")]


def test_paging(spark):
    df = spark.createDataFrame([(c,) for c in "abcde"], "r string")
    rows = lambda *a: ["".join(r.r for r in page(df, *a)[0].collect()), page(df, *a)[1]]
    assert rows(2) == ["ab", True] and rows("2x", "1") == ["bc", True] and rows(0, -1) == ["abcde", False] and rows("x", None) == ["abcde", False] and rows(None, 3) == ["de", True]


# ------------------------------------------------------------- structures


def test_tokens_and_trees():
    assert S.tokenize("⿰木{12}&U-1;@l一︀*３") == S.Pattern(("⿰", "木", "{12}", "&U-1;", "@L", "一︀"), 3)
    assert S.tokenize("↔a × x").times == 1 and S.tokenize("⊖ab").tokens[0] == "㇯"
    t = list("⿰木⿱一丨")
    assert S.node_end(t, 0) == 5 and S.node_end(t, 2) == 5 and S.node_end(t[:3], 0) is None
    assert S.project(["@R", *t]) == list("⿱一丨") and S.project(["@T", "@R", *t]) == ["一"]
    with pytest.raises(ValueError):
        S.project(["@L", "木"])
    assert S.order_overlaid(list("⿻⿰木木丨")) == list("⿻丨⿰木木") and S.order_overlaid(list("⿻？丨")) == list("⿻？丨")
    assert [p.tokens for p in S.overlaid_orders(S.tokenize("⿻一丨"))] == [("&OL3;", "？", "一", "丨"), ("&OL3;", "？", "丨", "一")]
    assert S.reduce_subtractions("㱐", list("㇯武㇂")) == [("武", ["⿻", "㱐", "㇂"])]
    assert S.reduce_subtractions("𠆱", list("⿰亻㇯斗丶")) == [("𠆱", ["⿰", "亻", "&s-斗-丶;"]), ("斗", ["⿻", "&s-斗-丶;", "丶"])]


def test_decomposer_sources_and_cycles():
    d = S.Decomposer({"a": {"G": ["⿰ b c"]}, "b": {"T": ["⿱ x y"], "H": ["⿱ y x"]}, "c": {"J": ["⿰ c d"]}, "z": {"G": ["？"]}})
    assert d.decompose("a", "G") == [tuple("⿰⿱xy⿰cd")] and d.fallbacks == {("b", "G")}
    assert d.decompose("z", "G") == [("&c-z-1;",)]
    assert S.Decomposer({"a": {"G": ["⿰ b b"]}, "b": {"G": ["⿱ x y", "⿱ y x"]}}).decompose("a", "G").__len__() == 4


def test_tables_of_trees(spark):
    shared = S.decompose_table(bindings.trees(spark))
    joined = S.decompose_table(bindings.trees(spark), shared=0)
    assert sorted(shared.collect()) == sorted(joined.collect())
    assert joined_trees(bindings.trees(spark), "江") == "⿰氵工"
    assert [r.ids for r in decompose_text(bindings.trees(spark), "江").collect()] == ["⿰氵⿱一⿱丨一"]


def test_truncated_trees_and_anchors(spark):
    t = spark.createDataFrame([("X", "⿰ 火"), ("Y", "⿰ 木 木")], "UCS string, IDS_tokens string")
    find = lambda *p: [r.UCS for r in S.search(t, p).collect()]
    assert find("§？§") == ["Y"] and find("§⿰xx§") == ["Y"] and find("？") == [] and find("") == [] and find("", "火") == ["X"] and find("§木*2") == []


# ------------------------------------------------------------- documents


def full_catalog(spark):
    make, t = spark.createDataFrame, dict(character_tables(spark))
    text = lambda names, rows: make(rows, files.text_schema(names))
    mji = text([c for c in files.MJI if c not in files.MJI_NUMBERS], [tuple({"MJ文字図形名": "MJ1", "対応するUCS": "漢", "実装したUCS": "漢"}.get(c) for c in files.MJI if c not in files.MJI_NUMBERS)])
    t["mji"] = mji.withColumns({c: F.lit(13 if c == "総画数" else None).cast("long") for c in files.MJI_NUMBERS})
    t["mji_rsindex"] = make([("MJ1", 85, 10)], "`MJ文字図形名` string, `部首` long, `内画数` long")
    t["mji_changelog"] = make([("MJ1", "2010")], "`MJ文字図形名` string, `更新履歴` string")
    t["mjsm"] = make([("MJ1", "汉", None, "辞書類等による関連字", None, None)], "`MJ文字図形名` string, `縮退UCS` string, `縮退X0213` string, `表` string, `順位` int, `ホップ数` int")
    t["aj1"] = make([(1533, "漢", 0, 1, 1, 1, 1), (9999, "漢", 1, 1, 0, 0, 0)], "CID int, UCS string, vertical int, UniJIS int, UniJIS2004 int, UniJISX0213 int, UniJISX02132004 int")
    t["svs_cjkci"] = make([("\u795e\ufe00", "\ufa19")], "SVS string, CJKCI string")
    t["joyo"] = text(("漢字", "音訓", "例", "備考"), [("漢", "カン", '["漢字","漢語"]', None)])
    t["doon"] = text(files.DOON, [("漢", "汗", "a", "b", "c")])
    t["nyukan"] = make([("類字", "6F22", "漢", "6C49", "汉", 1)], "`正字の種類` string, `簡体字等の文字コード等` string, `簡体字等のUCS` string, `正字の文字コード等` string, `正字のUCS` string, `順位` int")
    t["tghb"] = make([("0001", "汉", 1, 5, None)], "`序号` string, `规范字` string, `级` int, `笔画` int, `註解` string")
    t["tghb_variants"] = text(files.TGHB_VARIANTS, [("0001", "汉", "漢", "漢", None)])
    t["mjih"] = text("MJ文字図形名 文字 CharacterName UCS符号位置 字母 字母のUCS符号位置 戸籍統一文字番号 学術用変体仮名番号 国語研URL 備考".split(), [("MJ9", "𛀂", "n", None, "漢", None, None, None, None, None)])
    t["mjih_phonetic"] = text(("MJ文字図形名", "文字", "音価"), [("MJ9", "𛀂", "か")])
    return t


def test_documents_have_all_fields(spark):
    t = full_catalog(spark)
    got = {r.char: json.loads(r.document) for r in documents.character_documents(t, spark.createDataFrame([("漢",), ("q",), ("\u795e",), ("\ufa19",)], "char string")).collect()}
    d = got["漢"]
    assert list(d) == list(documents.FIELDS) and len(d) == 24
    assert d["aj1"] == {"CID": 1533, "jp90": 1533, "jp90_V": 9999, "jp04": 1533, "jp04_V": None, "mac_jp90": 1533, "mac_jp90_V": None, "mac_jp04": 1533, "mac_jp04_V": None}
    assert d["joyo"] == [{"音訓": "カン", "例": ["漢字", "漢語"], "備考": None}]
    assert d["tghb"][0]["异体字"] == [{"繁体字": "漢", "异体字": "漢", "註解": None}] and d["tghb"][0]["规范字"] == "汉"
    m = d["mji"][0]
    assert len(m) == 29 and m["部首・内画数"] == [[85, 10, "水"]] and m["読み"] == ["から", "カン"] and m["mjsm"] == [["辞書類等による関連字", "U+6C49", "汉"]] and m["対応する互換漢字"] is None
    assert d["mjih"][0]["音価"] == ["か"] and d["nyukan"][0]["順位"] == 1 and d["doon"][0]["採用した文書"] == "c"
    assert got["\u795e"]["svs_cjkci"][0]["SVS"] == "795E_FE00"
    q = got["q"]
    assert q["aj1"] is None and q["ids"] == [] and q["unihan"] == {} and q["kdpv"] == {} and q["unihan_rs"] == {"kRSAdobe_Japan1_6": None, "kRSUnicode": None}
    with pytest.raises(documents.UnknownField):
        documents.character_documents(t, spark.createDataFrame([("漢",)], "char string"), ["no"])


def test_references_are_cut_at_a_hundred(spark):
    u = spark.createDataFrame([(chr(0x4E00 + k), "kDefinition", "see 龜") for k in range(150)], "UCS string, property string, value string")
    d = documents.character_documents({"unihan_value_ref": D.unihan_value_ref(u)}, spark.createDataFrame([("龜",)], "char string"), ["unihan_fts"]).first()
    rows = json.loads(d.document)["unihan_fts"]
    assert [r[1] for r in rows] == [chr(0x4E00 + k) for k in range(100)]


def test_engine(spark):
    t = full_catalog(spark) | {"structures": S.decompose_table(bindings.trees(spark))}
    t["joyo_kangxi"] = spark.createDataFrame([("乗", "乘")], "`漢字` string, `康熙字典体` string")
    e = Engine(spark, t)
    found = e.find(ids=["⿰"], limit=2)
    assert [r.r for r in found["results"].collect()] == ["X", "信"] and found["done"] is False
    assert e.find(whole=["⿰火土"])["total"] == 1
    assert [r.r for r in e.find(ids=["⿰木火"], all_results=True)["results"].collect()] == []
    assert [r.r for r in e.find(p=["totalStrokes.ge"], q=["13"])["results"].collect()] == ["漢"]
    assert e.candidates(["⿰火土"]).collect()[0].UCS == "灶" and spark.sql("select count(*) from results").first()[0] == 1
    rows = {(r.c1, r.c2, r.r, r.f) for r in e.variants(["漢"]).collect()}
    assert ("漢", "汉", "tghb_规范字", 1) in rows and ("漢", "汗", "同音の漢字による書きかえ", 0) in rows
    assert "graph LR" in graph.mermaid(sorted(rows), ["漢"])
    assert [r.collection for r in e.ivs_list("U+4E00").collect()] == ["ExampleCollection"] * 2
    for bad in ({}, {"p": ["a"]}):
        with pytest.raises(BadRequest):
            e.find(**bad)
    with pytest.raises(BadRequest):
        parse_char("ab")
    assert parse_char("u+6f22") == "漢" and json.loads(e.document(["漢"], ["UCS"]).first().document) == {"UCS": "U+6F22"}


# ------------------------------------------------------------- files


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


class Rows(list):
    """Rows that equal a list of the same rows in any order."""

    def __eq__(self, other):
        return sorted(map(str, self)) == sorted(map(str, other))


def rows(df):
    return Rows(tuple(r) for r in df.collect())


def test_files(spark, tmp_path):
    p = lambda name, text: put(tmp_path, name, text)
    assert rows(files.unihan(spark, p("u.txt", '# c\nU+4E00\tkDefinition\tone "a"\n\nU+20000\tkX\ty\n'))) == [("一", "kDefinition", 'one "a"'), ("𠀀", "kX", "y")]
    assert rows(files.radicals(spark, p("r.txt", "# c\n1; 2F00; 4E00\n90'; 2EA6; 4E2C\n182''; ; 322C4\n")).select("radical", "部首", "radical_character")) == [("1", 1, "⼀"), ("182''", None, None), ("90'", None, "⺦")]
    assert rows(files.radical_equivalents(spark, p("e.txt", "2E81 ; 5382 # x\n2E82..2E84 ; 4E5B\n# 2E80; CJK RADICAL REPEAT\n"))) == [("⺀", None), ("⺁", "厂"), ("⺂", "乛"), ("⺃", "乛"), ("⺄", "乛")]
    us = files.usource(spark, p("s.txt", "# c\nUTC-1;A;U+4E00;1.1;x;⿰&A;木;K*L;say &b; it;12;1\nUTC-2;B;;2.0;;;;;;\n"))
    assert rows(us["usource"].where("U_source_ID = 'UTC-1'"))[0][2:7] == ("一", "1.1", "x", "⿰&A;木", "say &b; it") and rows(us["usource_source"]) == [("UTC-1", "K"), ("UTC-1", "L")]
    ids = files.ids(spark, [p("i1.txt", "# c\nU+2B81E\t𫠞\t^⿰a$(G)\nU+4E00\t一\t^一$(GT)\t*c1; c2\nU+4E00\t一\t^丶$(J)\n"), p("i2.txt", "U+2B81E\t𫠞\t^⿰日欠$(G)\t^x$(T)\nU+276AD\t\U000276ad\tfree text\n")])
    assert rows(ids["ids"]) == [("一", "J", "丶"), ("𫠞", "G", "⿰日欠"), ("𫠞", "T", "x")] and rows(ids["ids_comment"]) == [("\U000276ad", "free text")]
    with pytest.raises(Exception, match="syntax error"):
        files.ids(spark, [p("i3.txt", "U+4E01\t丁\tbad\n")])["ids"].collect()
    aj = files.aj1(spark, p("c.txt", "# c\nCID\tUniJIS-UTF32\tUniJIS2004-UTF32\tUniJISX0213-UTF32\tUniJISX02132004-UTF32\n1\t4e00,4e01v\t*\t4e00\t4e00\n"))
    assert rows(aj) == [(1, "一", 0, 1, 0, 1, 1), (1, "丁", 1, 1, 0, 0, 0)]
    k = files.kdpv(spark, [p("cjkvi-variants_a.txt", "# c\nr/a,<name>,甲\nr/a,<rev>,r/b\nr/b,<name>,乙\nx,<other>,y\n一,r/a,壱,note\n"), p("cjkvi-variants_jp-old-style.txt", "#h\n亜\t亞\n神\t\t神\t# c\n")])
    assert rows(k["kdpv"]) == [("一", "r/a", "壱", "note"), ("亜", "jp/old-style", "亞", None), ("神", "jp/old-style/compat", "神", "c")]
    assert rows(k["kdpv_rels"].where("rel = 'r/a'")) == [("r/a", "甲", "r/b", "乙")]
    assert rows(files.tabbed(spark, p("t.txt", "h1\th2\th3\th4\th5\n0001\t一\t1\t1\t\n"), files.TGHB, ("级", "笔画"))) == [("0001", "一", 1, 1, None)]
    assert rows(files.ivs(spark, p("v.csv", "IVS,collection,code\n4E00_E0100,Adobe-Japan1,CID+1200\n4E01_E0101,X,y\n"))) == [("一\U000e0100", "Adobe-Japan1", "CID+1200"), ("丁\U000e0101", "X", "y")]
    assert rows(files.ivd_lines(spark, p("ivd.txt", "# c\n4E00 E0100; Adobe-Japan1; CID+1200\n"))) == [("4E00_E0100", "Adobe-Japan1", "CID+1200")]
    assert rows(files.svs_lines(spark, p("svs.txt", "795E FE00; CJK COMPATIBILITY IDEOGRAPH-FA19;  # x\n"))) == [("\u795e\ufe00", "\ufa19")]
    assert rows(files.nyukan(spark, [("6F22", "6C49", "E000")], [("4E00", "4E01", "")])) == [("異体字", "6F22", "漢", "6C49", "汉", 1), ("異体字", "6F22", "漢", "E000", None, 2), ("類字", "4E00", "一", "4E01", "丁", 1)]
    j = files.joyo(spark, [{"subject": "乗", "reading": "ジョウ", "examples": ["乗数"], "note": None, "kangxi": ["乘"], "acceptable": "乘"}])
    assert rows(j["joyo"]) == [("乗", "ジョウ", '["乗数"]', None)] and rows(j["joyo_kangxi"]) == [("乗", "乘")] and j["joyo_acceptable"].count() == 1


def test_mj_files(spark, tmp_path):
    head = ["MJ文字図形名", "対応するUCS", "実装したUCS", "実装したMoji_JohoコレクションIVS", "実装したSVS", "戸籍統一文字番号", "住基ネット統一文字コード", "入管正字コード", "入管外字コード", "漢字施策", "対応する互換漢字", "X0213", "X0213 包摂連番", "X0213 包摂区分", "X0212", "MJ文字図形バージョン", "登記統一文字番号(参考)", *(f"{a}{k}(参考)" for k in range(1, 5) for a in ("部首", "内画数")), "総画数(参考)", "読み(参考)", "大漢和", "日本語漢字辞典", "新大字典", "大字源", "大漢語林", "更新履歴", "備考"]
    row = {"MJ文字図形名": "MJ1", "対応するUCS": "U+4E00", "実装したUCS": "U+4E00", "実装したMoji_JohoコレクションIVS": "4E01_E0100;4E00_E0101;4E00_E0102", "部首1(参考)": "1", "内画数1(参考)": "0", "部首2(参考)": "2", "総画数(参考)": "1", "読み(参考)": "イチ・ひと", "更新履歴": "a;b"}
    t = files.mji(spark, put(tmp_path, "m.csv", ",".join(head) + "\n" + ",".join(row.get(h, "") for h in head) + "\n"))
    m = t["mji"].first()
    assert (m["対応するUCS"], m["実装したMoji_JohoコレクションIVS"], m["総画数"], m["備考"]) == ("一", "一\U000e0101", 1, None)
    assert rows(t["mji_duplicated_ivs"]) == [("MJ1", "一\U000e0102"), ("MJ1", "丁\U000e0100")]
    assert rows(t["mji_reading"]) == [("MJ1", "ひと"), ("MJ1", "イチ")] and rows(t["mji_rsindex"]) == [("MJ1", 1, 0)] and rows(t["mji_changelog"]) == [("MJ1", "a"), ("MJ1", "b")]
    content = {"content": [{"MJ文字図形名": "MJ1", "参考情報": "n", "読み・字形による類推": [{"JIS X 0213": "1-1-1", "UCS": "U+4E00"}], "法務省告示582号別表第四": [{"JIS X 0213": "x", "UCS": "U+4E01", "表": "一", "順位": "第2順位"}], "法務省戸籍法関連通達・通知": [{"UCS": "U+4E02", "種別": "戸籍統一文字情報", "付記": "親字 正字", "ホップ数": 1}]}]}
    s = files.mjsm(spark, put(tmp_path, "s.json", json.dumps(content, ensure_ascii=False)))
    assert rows(s["mjsm"].select("縮退UCS", "表", "順位", "ホップ数")) == [("一", "読み字形による類推", None, None), ("丁", "法務省告示582号別表第四_一", 2, None), ("丂", "戸籍統一文字情報_親字_正字", None, 1)]
    assert s["mjsm_note"].count() == 1
    h = files.mjih(spark, put(tmp_path, "h.csv", "﻿MJ文字図形名,font文字,CharacterName,UCS符号位置,字母,字母のUCS符号位置,音価１,音価２,音価３,戸籍統一文字番号,学術用変体仮名番号,国語研URL,備考\nMJ9,𛀂,n,U+1B002,安,U+5B89,あ,ア,,1,2,3,\n"))
    assert rows(h["mjih_phonetic"]) == [("MJ9", "𛀂", "あ"), ("MJ9", "𛀂", "ア")]


def test_sinks(spark, tmp_path):
    t = {"unihan": bindings.han(spark), "ref": D.unihan_value_ref(bindings.han(spark))}
    m = files.write_tables(t, f"file://{tmp_path}/out", keys={"ref": "ref"}, by_value={"unihan": "property"})
    back = files.read_tables(spark, f"file://{tmp_path}/out", t)
    assert m["unihan"]["rows"] == len(bindings._HAN) == back["unihan"].count() and rows(back["ref"]) == rows(t["ref"])
    new, stamp = files.needs_rebuild({"a": b"1"}, None)
    assert new and files.needs_rebuild({"a": b"1"}, stamp) == (False, stamp) and files.needs_rebuild({"a": b"2"}, stamp)[0]
    assert files.postings(S.decompose_table(bindings.trees(spark))).where("token = '火'").count() == 2


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql(r"select regexp_all('a1 b2', '(?<l>[a-z])(?<d>[0-9])') as a, parse_int('0x1Fz', 16) as b, parse_int('x', 10) as c").first()
    assert json.loads(r.a) == [{"substr": "a1", "groups": {"l": "a", "d": "1"}}, {"substr": "b2", "groups": {"l": "b", "d": "2"}}] and (r.b, r.c) == (31, None)


def test_variants_of_a_whole_table(spark, tmp_path):
    kinds = ("ECONOMY", "PROMO", "SMALL")
    rows = [(k, k % 50 + 1, kinds[k * k % 7 % 3]) for k in range(1, 1201)]
    spark.createDataFrame(rows, "p_partkey int, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    edges = [(k, (k * 7 + size) % 2000, kind) for k, size, kind in rows]
    strong = {(a, b) for a, b, r in edges if r != "ECONOMY"}
    seen, last = set(range(1, 21)), None
    while seen != last:
        last = set(seen)
        seen |= {b for a, b in strong if a in last} | {a for a, b in strong if b in last}
    want = sorted((a, b, r, int((a, b) in strong)) for a, b, r in edges if a in seen or b in seen)
    assert any(a >= 400 for a, *_ in want)
    got = bindings.QUERIES["variants_bfs"](spark, str(tmp_path)).collect()
    assert sorted((r.c1, r.c2, r.r, r.f) for r in got) == want


def test_plain_patterns_match_as_trees_do(spark):
    rng = random.Random(3)
    texts = [[" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))] for _ in range(200)]
    t = spark.createDataFrame([(f"U{k}", x) for k, xs in enumerate(texts) for x in set(xs)], "UCS string, IDS_tokens string").persist()
    patterns = [(("a", "b"), 1), (("a", "a"), 2), (("§", "a"), 1), (("b", "§"), 1), (("§", "a", "b", "§"), 1), (("c",), 3), (("a",), 0), (("§", "d"), 2), (("d", "d", "d"), 2)]
    upper = t.select("UCS", F.upper("IDS_tokens").alias("IDS_tokens"))  # small letters are variables
    folder = f"{bindings.shared_folder(spark)}/plain-index"
    made = S.index_tables(upper)
    files.write_tables(made, folder, keys={"documents": "UCS", "postings": "token", "tokens": "token"})
    index = S.Index(**files.read_tables(spark, folder, made))
    for ps in [[p] for p in patterns] + [[patterns[0], patterns[5]], [patterns[3], patterns[1]]]:
        asked = [S.Pattern(tuple(x.upper() for x in tokens), n) for tokens, n in ps]
        assert all(S.is_plain(p, {}) for p in asked)
        want = sorted(f"U{k}" for k, xs in enumerate(texts) if any(all(naive.matches(x.upper().split(" "), p, {}) >= p.times for p in asked) for x in xs))
        assert [r.UCS for r in S.search(upper, asked).collect()] == want == [r.UCS for r in S.search(None, asked, index=index).collect()]
    assert not S.is_plain(S.Pattern(("A", "？")), {}) and not S.is_plain(S.Pattern(("A", "§", "B")), {}) and not S.is_plain(S.Pattern(("§",)), {}) and not S.is_plain(S.Pattern(("A",)), {"A": ["B"]})


def test_rare_tokens_are_found_by_their_postings(spark):
    t = spark.createDataFrame([(f"U{k}", "⿰ 木 火" if k == 7 else "⿰ 木 水" if k % 2 else "⿱ 木 土") for k in range(200)], "UCS string, IDS_tokens string")
    made = {n: x.persist() for n, x in S.index_tables(t).items()}
    found = S.search(None, ["⿰？火"], index=S.Index(**made))
    assert [r.UCS for r in found.collect()] == ["U7"] == [r.UCS for r in S.search(t, ["⿰？火"]).collect()]
    assert "postings" not in str(found) and found._jdf.queryExecution().logical().toString().count("LeftSemi") == 1
    assert S.search(None, ["金"], index=S.Index(**made)).count() == 0


def test_sql_export(spark, tmp_path):
    rows_ = [(1, "it's", None, [1, 2]), (2, "two\nlines\r", 1.5, None), (3, "", -0.25, [])]
    t = {"x": spark.createDataFrame(rows_, "a int, `b c` string, d double, e array<int>"), "none": spark.createDataFrame([], "a int")}
    sums = files.export_sql(t, f"file://{tmp_path}/sql").collect()
    assert {r.name for r in sums} >= {"x"}
    for r in sums:
        raw = (tmp_path / "sql" / r.name / r.file).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r.bytes, r.sha256)
    import duckdb

    c = duckdb.connect()
    c.execute('create table x (a int, "b c" varchar, d double, e varchar)')
    for r in spark.read.text(f"file://{tmp_path}/sql/x").collect():
        c.execute(r.value.replace("char(", "chr("))
    assert sorted(c.execute("select * from x").fetchall()) == [(1, "it's", None, "[1,2]"), (2, "two\nlines\r", 1.5, None), (3, "", -0.25, "[]")]


def test_nearest_ranks_against_sorting(spark):
    rng = random.Random(4)
    data = [(k, None if rng.random() < 0.05 else float(rng.choice([rng.randrange(5), rng.random()]))) for k in range(3) for _ in range(700)] + [(3, 1.0), (4, None)]
    got = {r.k: (r.p0, r.p50, r.p99, r.n) for r in D.nearest_ranks(spark.createDataFrame(data, "k int, v double"), "k", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    for k in range(4):
        v = sorted(x for j, x in data if j == k and x is not None)
        assert got[k] == (*(v[max(math.ceil(s * len(v)), 1) - 1] for s in (0, 0.5, 0.99)), len(v))
    assert set(got) == {0, 1, 2, 3}
    wide = [(0, x) for x in [float("inf"), float("-inf"), *(rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200) for _ in range(900)), *[5.0] * 50]]
    names = {f"p{k}": k / 20 for k in range(21)}
    r = D.nearest_ranks(spark.createDataFrame(wide, "k int, v double"), "k", "v", names).first()
    v = sorted(x for _, x in wide)
    assert {n: r[n] for n in names} == {n: v[max(math.ceil(s * len(v)), 1) - 1] for n, s in names.items()}
