"""Spelling variants, line deduplication and collocations against brute-force versions, and their stated results for odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphmill.llm import collocations, exchange, lines, spelling
from glyphmill.llm.common import Scratch, mix
from tests.llm.test_operators import LOWER, empty, odd_texts, table

# ------------------------------------------------------------- 11


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, least_chars, least_count, slip):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def brute_variants(words, times):
    by_word, forms = {w: [x for x in words if near(w, x)] for w in words}, {}
    for w, some in by_word.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(by_word[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def variants(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("slip", [199, 3])
def test_spelling_against_brute_force(spark, slip):
    rng = random.Random(slip)
    base = ["".join(rng.choice("abÀéÿz") for _ in range(rng.randrange(5, 9))) for _ in range(25)]
    texts = odd_texts() + ["x" * 5000, "ABCDEF abcdef aBcdefé × ÷ ß", "éa", None, ""]
    for _ in range(120):
        ws = [base[min(int(rng.expovariate(0.25)), 24)] for _ in range(30)]
        for k in range(len(ws)):
            if rng.random() < 0.2:
                p = rng.randrange(len(ws[k]) + 1)
                ws[k] = ws[k][:p] + rng.choice("abé") * rng.randrange(2) + ws[k][p + rng.randrange(2) :]
        texts.append(rng.choice(" .-7\n").join(ws))
    ids = [None if k == 3 else k // 2 for k in range(len(texts))]  # a null id and repeated ones
    words = spelling.vocabulary(table(spark, texts, ids), least_chars=4, least_count=2, slip=slip)
    want = brute_words(zip(ids, texts, strict=True), 4, 2, slip)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 100
    assert variants(spelling.spelling_variants(words, 3)) == brute_variants(want, 3)
    assert spelling.spelling_variants(spelling.vocabulary(empty(spark))).count() == 0


@pytest.mark.parametrize("part_words", [1, 8, 100])
def test_parts_of_a_trie_are_halved_without_losing_or_repeating_pairs(spark, part_words):
    rng = random.Random(part_words)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 50) for _ in range(200)}
    words |= {"common" * 3 + "".join(rng.choice("abc") for _ in range(5)): rng.randrange(1, 50) for _ in range(100)}  # one prefix
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best.best) for r in spelling.near_words(df, Scratch(spark), part_words=part_words, task_words=50).collect()}
    want = {}
    for w in words:
        some = [x for x in words if near(w, x)]
        if some:
            want[w] = (len(some), min(some, key=lambda x: (-words[x], x)))
    assert got == want


def test_crcs_are_joined():
    rng = random.Random(1)
    pairs = [("".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(9))).encode(), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 5000])))) for _ in range(60)]
    got = spelling.joined_crcs(*(np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_long_chains_of_forms(spark):
    words = {"a" * (6 + k): 6**k for k in range(22)}
    assert {r.word: r.root for r in spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == {w: "a" * 27 for w in words}


# ------------------------------------------------------------- 12


def brute_lines(rows, least_chars, least_docs):
    blank, docs = "\x20\x09\x0a\x0b\x0c\x0d", defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None:
                docs[line.strip(blank).translate(LOWER)].add(i)
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        gone = [i is not None and len(k := x.strip(blank).translate(LOWER)) >= least_chars and len(docs[k]) >= least_docs and i != max(docs[k]) for x in ls]
        out.append((i, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(None, None), (3, 2), (40, 7)])
def test_lines_against_brute_force(spark, sizes):
    rng = random.Random(9)
    common = ["the line that many documents have", "Ünïcödé line of twenty code points ", "exactly twenty chars", "nineteen characters", "short", "", "  \t", "x" * 3000]
    texts = odd_texts() + ["\n", "\n\n\n", "a\n\nb\n", "\r\n\r\n"]
    for _ in range(80):
        ls = [rng.choice(common) if rng.random() < 0.6 else f"line number {rng.randrange(60)} of some text" for _ in range(rng.randrange(12))]
        texts.append("\n".join(rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in ls))
    ids = [None if k % 17 == 0 else k - k % 9 % 2 for k in range(len(texts))]  # null ids, and ids of two rows
    got = lines.dedup_lines(table(spark, texts, ids), blocks=sizes[0], ranges=sizes[1]).collect()
    want = brute_lines(list(zip(ids, texts, strict=True)), 20, 3)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == want
    assert sum(x[2] for x in want) > 100
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_the_second_filter_holds_what_comes_twice():
    rng = np.random.default_rng(1)
    once, twice = (rng.integers(0, 2**64, n, np.uint64) for n in (200_000, 50_000))
    h = np.concatenate([once, twice, twice])
    rng.shuffle(h)
    two = lines.Filters(len(h))
    two.put(h, np.zeros(len(h), bool))
    assert two.suspects(twice).all() and two.suspects(once).mean() < 0.01
    marked = lines.Filters(10)
    marked.put(once[:10], np.arange(10) == 3)
    assert marked.suspects(once[:10])[3]


def test_hashes_that_meet_cost_nothing(spark, monkeypatch):
    """With one hash for all lines, keys are still told apart."""
    monkeypatch.setattr(lines, "span_hashes", lambda data, s, e: np.full(len(s), 7, np.uint64))
    texts = [f"a line that {k % 3} documents share\na line of document {k} alone" for k in range(12)]
    own = [lines.Lines(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 20) for t in texts]
    assert all(x.key(0) == t.split("\n")[0].encode() for x, t in zip(own, texts, strict=True))


# ------------------------------------------------------------- 13


def brute_collocations(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in (1, 2, 3):
                for k in range(len(ws) - size + 1):
                    counts[lang][tuple(ws[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cands.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in cands.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("fan", "top"), [(None, 2000), (4, 5)])
def test_collocations_against_brute_force(spark, monkeypatch, fan, top):
    """Also by relays, with pieces of a few hundred bytes."""
    if fan:
        for name, size in (("PIECE_BYTES", 600), ("BUCKET_BYTES", 900), ("TOKEN_BYTES", 300)):
            monkeypatch.setattr(collocations, name, size)
    rng = random.Random(11)
    texts = odd_texts()[:10] + ["a" * 5000, "é É 漢字 漢字 漢字", ". , ; :", "a\x0bb\x0cc\rd", "one two\tthree"]
    for _ in range(150):
        ws = [f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randrange(40))]
        for k in range(0, len(ws) - 3, 7):
            ws[k : k + 3] = rng.choice([["New", "york", "CITY"], ["de", "facto", "x"], ["hot", "dog", "stand"]])
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n"]) for w in ws))
    langs = [rng.choice(["en", "de", None, "x y"]) for _ in texts]
    df = spark.createDataFrame(list(zip(langs, texts, strict=True)), "lang string, text string").selectExpr("*", "'clash' AS piece", "'clash' AS word").repartition(3)
    got = collocations.collocations(df, least=4, top=top, fan=fan).collect()
    want = brute_collocations(list(zip(langs, texts, strict=True)), 4, top)
    assert sorted(tuple(r) for r in got) == want and len({r[0] for r in want}) == 4
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 10**12 + 7, 10**13 + 9), (3 * 10**9 + 1, 3 * 10**9 + 1, 3 * 10**9 + 2), (10, 10, 10), (10**15, 10**15, 10**15 + 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * r) for a, x, r in rows]


# ------------------------------------------------------------- the exchange


def test_mixing_is_undone():
    x = np.random.default_rng(3).integers(0, 2**64, 1000, np.uint64)
    assert (exchange.unmix(mix(x.copy())) == x).all()


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, np.uint64, np.int64])
def test_numbers_are_packed(kind):
    for n in (0, 1, 1000):
        x = np.random.default_rng(n).integers(np.iinfo(kind).min, np.iinfo(kind).max, n, kind)
        assert (exchange.unpack_numbers(exchange.pack_numbers(x)).astype(kind) == x).all() and (exchange.unpack_sorted(exchange.pack_sorted(np.sort(x.astype(np.uint64)))) == np.sort(x.astype(np.uint64))).all()


@pytest.mark.parametrize("fan", [1 << 11, 3])
@pytest.mark.parametrize("low", [False, True])
def test_exchange_against_counting(spark, fan, low):
    """One key that all units have, and few others; straight and by relays."""
    rng = random.Random(fan + low)
    units = {u: Counter({(5 << 40, 0): 1} | {(rng.randrange(1, 60) << 58, rng.randrange(3) * low): rng.randrange(1, 4) for _ in range(25)}) for u in range(40)}
    df = spark.createDataFrame([(u, [k[0] - 2**63 for k in c], [k[1] for k in c], list(c.values())) for u, c in units.items()], "unit long, h array<long>, low array<long>, n array<long>")

    def keys_of(row):
        h = (np.array(row["h"], np.int64).astype(np.uint64) + np.uint64(2**63)).astype(np.uint64)
        h, lo, n, _ = exchange.combined(h, np.array(row["low"], np.uint32) if low else None, np.array(row["n"], np.int64), np.add)
        return row["unit"], h, lo, n

    ex = exchange.Exchange(exchange.at_least(12), 16, 40, fan=fan)
    assert bool(ex.relays) == (fan == 3)
    replies, totals = ex.run(ex.ask(df, keys_of), Scratch(spark), "t", totals=True)
    total = sum(units.values(), Counter())
    got = {}
    for r in totals.collect():
        h = exchange.unpack_sorted(r["keys"])
        lows = exchange.unpack_numbers(r["low"]) if low else np.zeros(len(h), int)
        got |= dict(zip(zip(h.tolist(), lows.tolist(), strict=True), exchange.unpack_numbers(r["vals"]).tolist(), strict=True))
    assert got == {k: n for k, n in total.items() if n >= 12}
    by_unit = defaultdict(list)
    for r in replies.collect():
        by_unit[r._unit].append(r)
    import pyarrow as pa

    for row in df.collect():
        u, h, lo, _ = keys_of(row)
        answers = pa.table({"_bucket": pa.array([r._bucket for r in by_unit[u]], pa.int32()), "bits": pa.array([bytes(r.bits) for r in by_unit[u]], pa.binary())})
        bits = exchange.replies_to(h, ex.targets, answers)
        assert bits.tolist() == [total[(k, j)] >= 12 for k, j in zip(h.tolist(), lo.tolist() if low else [0] * len(h), strict=True)]


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows, 20, 3)}
    assert {tuple(r) for r in lines.op12_lines(spark, sf).collect()} == want
