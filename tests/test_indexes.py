"""Positional blocks, grams, bitmaps, ranges and many-seed reach against plain versions."""

import random
import re
import sqlite3
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.shared import shared_folder
from glyphmill.operators import bitmaps, grams, graph, phrases
from glyphmill.operators.properties import Field, Registry, UnknownKey
from glyphmill.sources import ranges


def folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/test-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- phrases


def test_phrases_against_scanning(spark):
    rng = random.Random(1)
    texts = {k * 37 - 900: " ".join(rng.choice("a b c dd É".split()) for _ in range(rng.randrange(30))) for k in range(60)}
    texts |= {10**15: "A a\tA\nb", 5: None, 6: "", 7: " \n", 2**53 + 1: "b a c", -(2**53) - 1: "b a c"}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    index = phrases.write_blocks(phrases.place_blocks(df, phrases.words_of(F.col("text")), range_docs=8), folder(spark, "places"))
    asked = [p.split(" ") for p in ("a", "a b", "a a", "a ？ b", "？ a", "b a c", "a b a b", "dd ？ ？ É", "none", "a none", "a a a")]
    got = {(r.phrase, r.doc_id): r.n for r in phrases.phrase_documents(index, asked, range_docs=8).collect()}
    want = {}
    for p in asked:
        for i, t in texts.items():
            ws = re.findall(r"[^\x20\x09-\x0d]+", (t or "").replace("A", "a"))
            n = sum(all(w == "？" or ws[k + j] == w for j, w in enumerate(p)) for k in range(len(ws) - len(p) + 1))
            if n:
                want[" ".join(p), i] = n
    assert got == want
    read = {r.phrase: (r.opened, r.met, r.blocks) for r in phrases.blocks_read(index, asked).collect()}
    assert read["none"][:2] == (0, 0) and read["a none"][1] == 0 < read["a none"][0] and read["a"][0] == read["a"][1] < read["a"][2] == index.count()
    with pytest.raises(ValueError):
        phrases.phrase_places(index, ["？"])


def test_a_phrase_reads_no_text_and_its_words_only(spark):
    df = spark.createDataFrame([(k, "a b c") for k in range(20)], "doc_id long, text string")
    index = phrases.write_blocks(phrases.place_blocks(df, phrases.words_of(F.col("text"))), folder(spark, "places"))
    plan = phrases.phrase_places(index, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "In(word, [a,b])" in plan and "text" not in plan and "Python" not in plan


# ------------------------------------------------------------- grams


def test_globs_by_grams_against_sqlite(spark):
    rng = random.Random(2)
    values = {"".join(rng.choice("abc]-x漢𠮷") for _ in range(rng.randrange(7))) for _ in range(400)} | {"", "a", "*", "a*b", "[x]", "a?b", "\x02a\x03", "new\nline"}
    df = spark.createDataFrame([(v,) for v in sorted(values)] + [(None,), ("a",)], "value string")
    index = grams.write_grams(grams.gram_rows(df), folder(spark, "grams"))
    lite = sqlite3.connect(":memory:")
    patterns = ["*", "a", "", "*a?b*", "a*", "*c", "?", "??", "[ab]*x", "*[^a]b?", "*漢*", "*𠮷[abc]*", "a**b", "*[]]*", "[", "*a[", "a?c*b?", "*ab*ba*", "*\n*", "*[a-c]-x", "?*[x]"]
    for p in patterns:
        want = sorted(v for v in values if lite.execute("select ? glob ?", (v, p)).fetchone()[0])
        assert sorted(r.value for r in grams.glob_values(index, p).collect()) == want, p
        tested = {r.value for r in grams.candidates(index, p).collect()}
        assert set(want) <= tested
    # few values are tested where a pattern holds grams
    assert grams.candidates(index, "*a?b*").count() < len(values) / 4


# ------------------------------------------------------------- bitmaps


def registry():
    fields = [Field("size", "t", "size", "number", "r", ops=("lt", "ge", "has")), Field("name", "t", "name", "token", "r", ops=("glob", "has")), Field("kind", "u", "kind", "text", "r", ops=("has",))]
    return Registry(fields, ("t", "r"))


def test_bitmap_searches_equal_joins(spark):
    rng = random.Random(3)
    t = spark.createDataFrame([(f"r{rng.randrange(300)}" if rng.random() < 0.95 else None, rng.choice([None, rng.randrange(9)]), rng.choice([None, "a b", "b", "ab c", ""])) for _ in range(500)], "r string, size int, name string").persist()
    u = spark.createDataFrame([(f"r{rng.randrange(400)}", rng.choice(["x", "y", None])) for _ in range(200)], "r string, kind string").persist()
    tables, reg = {"t": t, "u": u}, registry()
    numbers, maps = reg.bitmaps(tables)
    ids = sorted(r.id for r in numbers.collect())
    assert ids == list(range(len(ids)))
    maps = bitmaps.write_bitmaps(maps, folder(spark, "bitmaps"))
    for keys, values in ((["size.ge"], ["5"]), (["size.lt", "name"], ["7", "b"]), (["name.ne"], ["b"]), (["size.notHas"], [""]), (["kind.has", "size.ge.ne"], ["", "3"]), (["kind", "name.notGlob"], ["x", "a*"]), (["name.eq"], ["none"]), (["kind.ne", "kind.has", "size"], ["x", "", "2"])):
        found = reg.search_bitmaps(numbers, maps, keys, values)
        want = {r.r for r in reg.search(tables, keys, values).collect()} & {r.r for r in numbers.collect()}
        assert [r.r for r in found.collect()] == sorted(want), keys
        conditions = [reg.condition(k, q) for k, q in zip(keys, values, strict=True)]
        assert bitmaps.count(bitmaps.combine(maps, conditions)).first().n == len(want)
    plan = reg.search_bitmaps(numbers, maps, ["size.ge", "name.ne", "kind"], ["1", "b", "x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [key") == 1  # the bitmaps are read once
    with pytest.raises(UnknownKey):
        reg.condition("size.glob", "x")
    empty = {"t": t.limit(0), "u": u.limit(0)}
    assert reg.search_bitmaps(*reg.bitmaps(empty), ["size.ge"], ["1"]).count() == 0


# ------------------------------------------------------------- ranges


def test_pages_and_updates_of_a_store(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randrange(500)]) if k % 50 == 0 else rng.randrange(500), k, rng.choice(["x", None, "y"])) for k in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, range string").withColumnRenamed("range", "c")
    store = ranges.build_ranges(df, ["a", "b"], folder(spark, "store"), 100)
    entries = store.entries()
    assert 15 <= len(entries) <= 40 and sum(e.rows for e in entries) == 2000
    order = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1]))
    for offset, limit in ((0, 5), (1234, 30), (95, 20), (1990, 50), (2000, 5), (7, 0), (0, 2000)):
        assert [tuple(r) for r in store.page(offset, limit).collect()] == order[offset : offset + limit]
    assert len(store.page(1234, 3).inputFiles()) <= 2
    # one row in a hundred changes, one goes, one is new: only their ranges are written
    changed = [r if r[1] % 100 else (r[0], r[1], "changed") for r in order if r[1] != 77] + [(3, 10**6, "new")]
    update, written = ranges.update_ranges(store, spark.createDataFrame(changed, "a int, b int, c string").repartition(5))
    touched = {r[1] for r in order if r[1] % 100 == 0} | {77, 10**6}
    by_range = {e.range: {r.b for r in update.read([e]).collect()} | {r.b for r in store.read([e]).collect()} for e in update.entries()}
    assert written == sorted(k for k, bs in by_range.items() if bs & touched) and 0 < len(written) < len(entries)
    assert sorted(map(str, (tuple(r) for r in update.read().collect()))) == sorted(map(str, changed))
    assert sorted(map(str, (tuple(r) for r in store.read().collect()))) == sorted(map(str, rows))  # older readers keep theirs
    full = ranges.build_ranges(spark.createDataFrame(changed, "a int, b int, c string"), ["a", "b"], folder(spark, "full"), 100)
    assert sorted(full.read().collect(), key=str) == sorted(update.read().collect(), key=str)
    again, none = ranges.update_ranges(update, spark.createDataFrame(changed, "a int, b int, c string"))
    assert none == [] and again is update
    gone, _ = ranges.update_ranges(update, df.limit(0))
    assert gone.read().count() == 0 and gone.page(0, 5).count() == 0
    nothing = ranges.build_ranges(df.limit(0), ["a"], folder(spark, "none"))
    assert nothing.read().count() == 0 and ranges.update_ranges(nothing, df)[0].read().count() == 2000


def test_files_of_a_store_hold_many_ranges(spark, monkeypatch):
    # keys that go on over one or several marks, nulls, and few keys
    rows = [(k // 7 if k % 90 else None, k) for k in range(1500)] + [(500 + k // 45, k) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(3)
    store = ranges.build_ranges(df, ["a"], folder(spark, "many"), 10)
    entries = store.entries()
    assert len(entries) > 100 and len(store.read().inputFiles()) <= 8
    held = [{r.a for r in store.read([e]).collect()} for e in entries[::9]]
    assert all(not a & b for a, b in zip(held, held[1:], strict=False))
    for e in entries[::9]:
        assert e.rows == store.read([e]).count() and (e.range == 0 or store.read([e]).agg(F.expr("min(struct(a))")).collect()[0][0] == e.lo)
    # rows of half of the ranges change: more runs than a filter names
    monkeypatch.setattr(ranges, "_NAMED", 20)
    update, written = ranges.update_ranges(store, df.withColumn("b", F.when(F.col("a") % 4 < 2, F.col("b")).otherwise(F.col("b") + 1)))
    assert len(entries) > len(written) > 50
    assert sorted(tuple(r) for r in update.read().where("a is not null").collect()) == sorted((a, b if a % 4 < 2 else b + 1) for a, b in rows if a is not None)
    assert update.read().count() == len(rows)


# ------------------------------------------------------------- many seeds


def test_reach_of_many_seeds_against_walking(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(150), rng.randrange(150), rng.choice(["strong", "cjkvi/non-cognate", "kStrange_I"])) for _ in range(170)] + [(1, 1, "strong")]
    seeds = [*range(0, 200, 1), 7, None]
    near = defaultdict(set)
    for a, b, r in edges:
        if r == "strong":
            near[a].add(b)
            near[b].add(a)
    want = set()
    for s in set(seeds) - {None}:
        todo, seen = [s], {s}
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want |= {(s, c) for c in seen}
    got = graph.reach(spark.createDataFrame(edges, "c1 long, c2 long, r string"), spark.createDataFrame([(s,) for s in seeds], "s long")).collect()
    assert len(got) == len(want) and {(r.seed, r.c) for r in got} == want
    assert graph.reach(spark.createDataFrame([], "c1 long, c2 long, r string"), spark.createDataFrame([(4,)], "s long")).collect() == [(4, 4)]


@pytest.mark.parametrize("few", [10**4, 5, 0])
def test_variants_by_named_fronts_and_by_tables(spark, few):
    rng = random.Random(9)
    names = [f"n{k}" for k in range(60)] + ["it's", "a\\b", "漢", 'q"']
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["strong", "other", "cjkvi/non-cognate", "kStrange_I"])) for _ in range(70)]
    near, f = defaultdict(set), set()
    for a, b, r in edges:
        if r in ("strong", "other"):
            near[a].add(b)
            near[b].add(a)
            f.add((a, b))
    for seeds in (["it's", "n3"], ["a\\b"], ["unknown"], []):
        seen, todo = set(seeds), list(seeds)
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want = sorted((a, b, r, int((a, b) in f)) for a, b, r in edges if a in seen or b in seen)
        got = graph.variants(spark.createDataFrame(edges, "c1 string, c2 string, r string"), seeds, few=few)
        assert sorted(tuple(r) for r in got.collect()) == want
