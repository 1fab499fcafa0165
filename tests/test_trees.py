"""Trees: pages, patterns over intervals, shared subtrees, automata - each against a plain version."""

import random
import re
import time
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import structures as S
from glyphmill.operators import trees as T
from glyphmill.sources import html
from tests import naive


def random_tree(rng, deep=4):
    t = rng.choice(["⿰", "⿱", "⿲"]) if deep and rng.random() < 0.6 else rng.choice("ABC")
    return [t] + [x for _ in range(S.ARITY.get(t, 0)) for x in random_tree(rng, deep - 1)]


def test_both_tokenizers_agree(spark):
    rng = random.Random(8)
    bits = ["⿰", "木", "𠮷", "〆\ufe00", "葛\U000e0101", "\ufe00", "⿱\ufe00", "&U1;", "&x", ";", "{12}", "{", "}", "@l", "@R", "@x", "@", "↔", "⊖", " ", "\u3000", "\u00a0", "\t", "a", "？", "々", "⺡", "1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(500)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.tokens_column("t").alias("x")).collect()
    for k, x in got:
        assert x == " ".join(S.tokenize(texts[k]).tokens), texts[k]
    assert S.tokenize("〆\ufe00木").tokens == ("〆\ufe00", "木") and S.tokenize("&U1;@l{3}").tokens == ("&U1;", "@L", "{3}")


def test_ends_of_prefix_trees(spark):
    rng = random.Random(1)
    trees = [random_tree(rng) for _ in range(60)]
    trees += [t[: rng.randrange(1, len(t) + 1)] for t in trees] + [["A", "B"], ["A"]]  # truncated ones, and several in a row
    got = spark.createDataFrame([(k, t) for k, t in enumerate(trees)], "k int, t array<string>").select("k", T.prefix_ends(F.col("t"), S.ARITY).alias("e")).collect()
    for k, e in got:
        assert e == [S.node_end(trees[k], i) for i in range(len(trees[k]))]


def test_places_against_matching_step_by_step(spark):
    rng = random.Random(2)
    trees = [random_tree(rng) for _ in range(150)]
    trees += [t[: rng.randrange(1, len(t) + 1)] for t in trees[:20]]
    own = {"C": [["A", "B"], ["⿰", "A", "A"], ["C"]]}
    patterns = ["A", "⿰ ？ A", "§ ⿱ x x §", "⿰ x ⿱ x y", "x x", "§ x", "？", "C C", "⿰ C ？", "⿲ x ？ x", "A §", "§ A §", "x y x", "B C", "§ ？ §"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(trees)], "k int, t array<string>").withColumn("e", T.prefix_ends(F.col("t"), S.ARITY)).persist()
    for known in ({}, own):
        cols = [F.size(T.match_places("t", "e", tuple(p.split(" ")), known)).alias(str(i)) for i, p in enumerate(patterns)]
        for row in df.select("k", *cols).collect():
            for i, p in enumerate(patterns):
                assert row[i + 1] == naive.matches(trees[row.k], S.Pattern(tuple(p.split(" "))), known), (trees[row.k], p)


def test_searches_against_matching_step_by_step(spark):
    rng = random.Random(3)
    rows = [(f"U{k}", " ".join(random_tree(rng, 3))) for k in range(200) for _ in range(rng.randrange(1, 3))] + [("C", "⿰ A B"), ("C", "⿱ B A")]
    t = spark.createDataFrame(rows, "UCS string, IDS_tokens string").persist()
    known = {"C": [["⿰", "A", "B"], ["⿱", "B", "A"]]}
    by_char = defaultdict(set)
    for u, x in rows:
        by_char[u].add(x)
    for ps in (["§⿰？C§"], ["⿱xx"], ["C*2"], ["⿰xx", "C"], ["§⿲？？A§"], ["⿰⿰AB？", "B*2"], ["？"], ["xy"]):
        asked = [S.tokenize(p) for p in ps]
        empty = any(all(t == "？" or T.is_variable(t) for t in p.tokens) for p in asked)
        want = sorted(u for u, xs in by_char.items() if not empty and any(all(naive.matches(x.split(" "), p, known) >= p.times for p in asked) for x in xs))
        assert [r.UCS for r in S.search(t, ps).collect()] == want, ps


def test_automata_of_alternatives(spark):
    """Linear in the alternatives; where they can be enumerated, the same documents."""
    rng = random.Random(4)
    chars = [chr(0x4E00 + k) for k in range(12)]
    own = {c: [f"⿰ {c} {k}" for k in range(7)] + [c] for c in chars}
    began = time.perf_counter()
    regex = S.candidate_regex(S.Pattern(tuple(chars)), own)
    assert time.perf_counter() - began < 1 and len(regex) < 3000
    docs = [" § " + " ".join(rng.choice(own[c]) for c in chars) + " § " for _ in range(20)] + [" § " + " ".join(chars[1:]) + " § "]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string")
    began = time.perf_counter()
    assert {r.k for r in df.where(S.candidate_test([[S.Pattern(tuple(chars))]], own, F.col("doc"))).collect()} == set(range(20))
    assert time.perf_counter() - began < 10
    short = {"A": ["A", "⿰ B C", "D"], "B": ["B", "⿱ A D"]}
    docs = [f" § {' '.join(random_tree(rng, 2))} § {' '.join(random_tree(rng, 3))} § " for _ in range(300)]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string")
    for tokens in (("A", "B"), ("⿰", "A", "B"), ("B", "A", "A"), ("§", "⿱", "A")):
        want = {k for k, d in enumerate(docs) for each in product(*(short.get(t, [t]) for t in tokens)) if f" {' '.join(each)} " in d}
        assert {r.k for r in df.where(S.candidate_test([[S.Pattern(tokens)]], short, F.col("doc"))).collect()} == want


# ------------------------------------------------------------- pages

PAGES = [
    None,
    "",
    "no tags &amp; < all",
    "<P>one<p>two <B>bold<p>three",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>",
    "<!-- <p> --><a href='x?a=1&amp;b=2' HREF=second>t&eacute;xt &#65;</a>",
    "<script>if (a < b) { x = '</p>' + \"<b>\" }</script><p>after",
    "<title>a <b> &lt;c&gt;</title><br/><img src=x><i>",
    "</b></i><p></q>text</p></p>",
    "<div title=\"a > b\"><p>x</div>y</p>",
    "<a href=unclosed",
    "<a href=\"unclosed quote>text</a>",
    "<textarea><p>raw</textarea>",
    "<script>never ended",
    "<table><tr><td>1<td>2<tr><td>3</table>",
    "<dl><dt>a<dd>b<dt>c</dl>",
    "<!DOCTYPE html><?php x ?><html><body>漢字<p>𠮷</html>",
    "<" * 50,
    "<b>" * 200 + "x",
]


def slow_tree(page):
    """(label, depth, text) of the nodes, character by character and with the rules written out."""
    page, at, stack, out = page or "", 0, [], []

    def close_to(k):
        del stack[k:]

    def text(x):
        if stack:
            stack[-1][2].append(html.unescape(x))

    while at < len(page):
        rest = page[at:]
        if rest.startswith("<!--"):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
        elif rest[:2] in ("<!", "<?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        elif re.match(r"</[A-Za-z]", rest):
            end = page.find(">", at)
            end = len(page) if end < 0 else end
            name = re.match(r"[^\s/>]*", page[at + 2 : end])[0].lower()
            at = min(end + 1, len(page))
            own = [k for k, x in enumerate(stack) if x[0] == name]
            if own:
                close_to(own[-1])
        elif re.match(r"<[A-Za-z]", rest):
            name = re.match(r"<([^\s/>]*)", rest)[1].lower()
            at += 1 + len(name)
            while at < len(page) and page[at] != ">":  # quotes hide the bracket; an open one ends the tag
                if page[at] in "\"'":
                    end = page.find(page[at], at + 1)
                    if end < 0:
                        break
                    at = end
                at += 1
            at += at < len(page) and page[at] == ">"
            border, ended = html.INSIDE.get(name, "").split(), html.AGAIN.get(name, "p" if name in html.BLOCKS else "").split()
            for k in reversed(range(len(stack))):
                if stack[k][0] in border:
                    break
                if stack[k][0] in ended:
                    close_to(k)
                    break
            node = (name, len(stack), [])
            out.append(node)
            if name in ("script", "style", "title", "textarea"):
                m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                inner = page[at : m.start()] if m else page[at:]
                node[2].append(inner if name in ("script", "style") else html.unescape(inner))
                at = len(page) if not m else (page.find(">", m.end()) + 1 or len(page))
            elif name not in html.VOID:
                stack.append(node)
        else:
            end = next((k for k in range(at + 1, len(page)) if re.match(r"<[A-Za-z!?]|</[A-Za-z]", page[k:])), len(page))
            text(page[at:end])
            at = end
    return [(a, b, "".join(c)) for a, b, c in out]


@pytest.mark.parametrize("page", PAGES)
def test_pages_against_reading_by_characters(page):
    labels, ends, depths, parents, texts, attributes = html.read_tree(page)
    assert list(zip(labels, depths, texts, strict=True)) == slow_tree(page)
    n = len(labels)
    assert len(attributes) == n and all(ends[k] == next((j for j in range(k + 1, n) if depths[j] <= depths[k]), n) for k in range(n))
    assert all((parents[k] is None) == (depths[k] == 0) and (parents[k] is None or (depths[parents[k]] == depths[k] - 1 and parents[k] < k < ends[parents[k]])) for k in range(n))


def test_random_pages_against_reading_by_characters():
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "text", "&amp;", "<br>", "<div a='>'>", "</div>", "<td>", "<tr>", "<table>", "</table>", "< ", "<!-- x -->", "<a href=1>", "</a>", "<script>", "</script>", "\"", ">", "<h1", " x=y>"]
    for _ in range(2000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        labels, _, depths, _, texts, _ = html.read_tree(page)
        assert list(zip(labels, depths, texts, strict=True)) == slow_tree(page), page


def test_links_and_titles(spark):
    df = spark.createDataFrame([(k, p, "clash") for k, p in enumerate(PAGES)], "page_id long, html string, labels string")
    trees = html.page_trees(df)
    assert [tuple(r) for r in html.links(trees).collect()] == [(5, 0, "x?a=1&b=2", "téxt A"), (10, 0, "unclosed", ""), (11, 0, "", '"unclosed quote>text')]
    assert {r.page_id: r.title for r in html.titles(trees).collect()} == {k: "a <b> <c>" if k == 7 else None for k in range(len(PAGES))}
    assert html.links(html.page_trees(df.limit(0))).count() == 0


def test_subtrees_against_comparing_texts(spark):
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<br>", "<div>", "</div>"]
    pages = PAGES + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(60)]
    pages += pages[-10:]
    want, kinds = Counter(), defaultdict(set)
    for k, page in enumerate(pages):
        labels, ends, depths, *_ = html.read_tree(page)
        for i in range(len(labels)):
            sig = tuple((labels[j], depths[j] - depths[i]) for j in range(i, ends[i]))
            want[sig] += 1
            kinds[sig].add(k)
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id long, html string")
    got = T.shared_subtrees(html.page_trees(df), "page_id").collect()
    assert len({r.digest for r in got}) == len(got)
    assert sorted((r.size, r.n, r.trees) for r in got) == sorted((len(s), n, len(kinds[s])) for s, n in want.items())
    assert T.shared_subtrees(html.page_trees(df.limit(0)), "page_id").count() == 0


def test_page_patterns_against_matching_step_by_step(spark):
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<br>", "<div>", "</div>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(80)]
    patterns = {"a": "p b", "b": "ｘ ｘ", "c": "ul ｘ ？ ｘ", "d": "§ p ？", "e": "li §", "f": "§ ｘ ｙ ｘ", "g": "？ ？ §"}
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id long, html string")
    got = {(r.page_id, r.pattern): r.n for r in T.tree_match(html.page_trees(df), {n: p.split(" ") for n, p in patterns.items()}, "page_id").collect()}

    def count(labels, ends, depths, p):
        n, total = len(labels), 0
        for start in range(min(1, n) if p[0] == "§" else n):
            at, bound, ok = start, {}, True
            for t in p:
                if t == "§":
                    ok = at in (0, n)
                elif t == "？" or T.is_wide(t):
                    ok = at < n
                    if ok:
                        own = tuple((labels[j], depths[j] - depths[at]) for j in range(at, ends[at]))
                        ok = t == "？" or bound.setdefault(t, own) == own
                        at = ends[at]
                else:
                    ok = at < n and labels[at] == t
                    at += 1
                if not ok:
                    break
            total += ok
        return total

    want = {(k, name): c for k, page in enumerate(pages) for name, p in patterns.items() if (c := count(*html.read_tree(page)[:3], p.split(" ")))}
    assert got == want
