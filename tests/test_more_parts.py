"""Queries over more parts than there are ideographs, against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def with_parts(folder, keys: str) -> str:
    """A folder with a table of parts of these keys."""
    c = duckdb.connect()
    c.execute(f"create table p as select *, row_number() over (order by p_partkey) - 1 as n from '{SF}/part.parquet'")
    c.execute(f"copy (select k as p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from ({keys}) join p on n = k % (select count(*) from p)) to '{folder}/part.parquet' (format parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """Parts and the tenths of their numbers; three share an ideograph with another, one is the component itself."""
    return with_parts(tmp_path_factory.mktemp("few"), "select distinct k // d as k from (values (123), (1234), (6440), (20900), (20912), (41800), (41812), (62711)) t(k), (values (1), (10), (100), (1000), (10000)) u(d)")


def compare(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{folder}/part.parquet'")
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = entry.queries()[name](spark, folder)
    assert sorted(map(str, df.select(*(f"`{n}`" for n in names)).collect())) == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, r, strict=True))})" for r in got.fetchall())


@pytest.mark.parametrize("name", ["build_catalog", "character_document", "character_keys", "character_search", "decompose_one", "full_decomposition", "idsfind_page", "structure_search"])
def test_catalog(spark, few, name):
    compare(spark, few, name)


CATALOGS = ["build_catalog", "character_document", "character_keys", "character_search", "decompose_one", "full_decomposition", "idsfind_page", "structure_search"]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Large keys with gaps, also where trees lead; with the same ideographs as small ones."""
    keys = [3, 12, 123, 12345, 1234567, 5_350_400, 5_350_412, 16_051_323, 1_000_000_123, 100_000_012, 10**12 + 1234, 10**12 + 12345, 10**15 + 123, 10**16 + 41]
    return with_parts(tmp_path_factory.mktemp("far"), f"select unnest({keys}) as k")


@pytest.mark.parametrize("name", CATALOGS)
def test_catalog_of_large_keys_with_gaps(spark, far, name):
    compare(spark, far, name)


@pytest.fixture(scope="module")
def huge(tmp_path_factory):
    """Keys whose multiples pass 64 bits; the SQL of character_keys multiplies by 17."""
    keys = [3, 12, 123, 12345, 41 * 10**16 + 7, 45 * 10**16 + 1234, 54 * 10**16 + 41]
    return with_parts(tmp_path_factory.mktemp("huge"), f"select unnest({keys}) as k")


def test_keys_of_huge_numbers(spark, huge):
    compare(spark, huge, "character_keys")


def test_character_search_builds_no_structures(spark, few, monkeypatch):
    from glyphmill.plans import bindings

    monkeypatch.setattr(bindings, "stored", None)
    compare(spark, few, "character_search")


def test_character_search_of_the_largest_key(spark, tmp_path):
    # the last one's text has what is searched
    compare(spark, with_parts(tmp_path, f"select unnest({[3, 123, 5 * 10**18 + 7, 2**63 - 33]}) as k"), "character_search")


def test_decompose_one_that_is_no_part(spark, tmp_path):
    compare(spark, with_parts(tmp_path, "select 12 as k"), "decompose_one")


def test_decompose_one_joins_no_trees(spark, few, monkeypatch):
    from glyphmill.operators import structures

    monkeypatch.setattr(structures, "reachable", None)
    compare(spark, few, "decompose_one")


def test_decompose_text_of_rings_and_several_sources(spark):
    from glyphmill.plans.engine import decompose_text

    ids = spark.createDataFrame([("a", "G", "⿰bc"), ("a", "J", "⿱bd"), ("b", "GT", "⿰zx"), ("c", "J", "⿱d⿰yd"), ("d", "U", "⿻zw"), ("e", "G", "⿰aa"), ("z", "G", "⿰za")], "UCS string, source string, IDS string")
    assert [r.ids for r in decompose_text(ids, "z").collect()] == ["⿰z⿰⿰zx⿱&OL3;&ol-d-1;zw⿰y&OL3;&ol-d-1;zw", "⿰z⿱⿰zx&OL3;&ol-d-1;zw"]
    assert decompose_text(ids, "x").collect() == decompose_text(ids.limit(0), "x").collect()


@pytest.mark.parametrize("name", ["reverse_references", "variant_map_rows"])
def test_references_and_variants(spark, few, name):
    compare(spark, few, name)


@pytest.mark.parametrize("name", ["document_fields", "similar_characters"])
def test_fields(spark, tmp_path, name):
    compare(spark, with_parts(tmp_path, "select range as k from range(20905)"), name)


def test_reach_by_components(spark):
    from glyphmill.operators import graph

    rels = spark.createDataFrame([(1, 2, "s"), (3, 2, "s"), (4, 4, "s"), (5, 6, "cjkvi/non-cognate")] + [(100 + k, 101 + k, "s") for k in range(40)], "c1 long, c2 long, r string")
    own, members = graph.reach_components(rels, spark.createDataFrame([(k,) for k in (3, 4, 5, 120, 120)], "s long"))
    assert sorted(own.collect()) == [(3, 1), (4, 4), (5, 5), (120, 100)]
    # a row a member, however many seeds reach it
    assert sorted(members.collect()) == sorted([(1, 1), (1, 2), (1, 3), (4, 4), (5, 5)] + [(100, 100 + k) for k in range(41)])


def test_blocks_of_a_range_over_several_batches(spark):
    from pyspark.sql import functions as F

    from glyphmill.operators import phrases

    docs = spark.createDataFrame([(k, None if k == 3 else f"a b{k % 4} A") for k in range(-9, 40)], "doc_id long, text string")
    blocks = phrases.place_blocks(docs, phrases.words_of(F.col("text")), range_docs=16)
    # texts move, words don't: there is no sort or aggregate of a row for each word
    assert "Generate" not in blocks._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.word, r.range): (r.n, r.places) for r in blocks.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in range(-9, 40):
        for pos, w in enumerate([] if k == 3 else ["a", f"b{k % 4}", "a"]):
            want.setdefault((w, k // 16), []).append((k % 16 << phrases.POSITION_BITS) + pos)
    assert got == {key: (len(v), v) for key, v in want.items()}


def test_titles_with_entities_that_the_sql_leaves(spark, tmp_path):
    page = "<html><title>a &quot;b&quot; &amp;copy; &copy; &amp</title><a href=\"x?a&lt;b&amp;c\">&middot;&gt;</a></html>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_titles", "html_links"):
        assert [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()] == duck.execute(entry.oracle_sql()[name]).fetchall()


def test_trees_by_reach_in_groups(spark, monkeypatch):
    from glyphmill.operators import structures as S

    monkeypatch.setattr(S, "GROUP_ROWS", 3)
    ids = spark.createDataFrame([("a1", "G", "⿰bc"), ("b", "G", "⿱cd"), ("c", "G", "⿰xy"), ("c", "J", "⿻yx"), ("d", "G", "⿰da")], "UCS string, source string, IDS string")
    assert sorted(S.decompose_table(ids, shared=0).collect()) == sorted(S.decompose_table(ids).collect())
