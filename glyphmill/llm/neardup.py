"""Near-duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A text's signature has LANES minima of its shingle set, BITS bits of each. Two sets of similarity J
differ in a lane with probability 1 - J. The lanes are split into CHUNKS chunks; if two signatures
differ in at most 2 * CHUNKS - 1 = 31 lanes, some chunk differs in at most one lane (pigeonhole),
so enumerating the allowed chunk errors - no lane or any one lane of a chunk left out - gives keys of
which such a pair shares one at least. A pair is a candidate if it differs in at most THRESHOLD = 28 lanes, so every pair
within the threshold shares a key. At similarity 0.85 a pair is beyond the
threshold with probability 8e-9, at 0.8 with 4e-6; at 0.3 it is within it with 1e-5, so texts that share no more than some boilerplate
don't chain up.

How it runs. Texts of equal sets (128-bit digests) are one class, represented by its smallest id. The
rows of a key are compared with the key's smallest id; those within the threshold are candidates of it. Only where
some row is not, and the key has more than two, is that row compared with all others of the key, in tiles of two
parts of KEY_PART rows; a tile returns a spanning forest of the pairs within the threshold. A component of
candidates comes together in tiles of bounded size, rows and bytes - two parts of it each, so that every pair meets
in a tile - where pairs are tried in order of signature distance, confirmed on full sets, and skipped once their ends
are linked. A tile returns at most a spanning forest. The components of those links are the result. No table is
collected, no step emits the pairs of a group. Work grows with the square of the number of different texts only
where these are near each other, or share a key without being near.

Cases: null and empty texts (and texts of blanks) have an empty set and link with nothing; a text of
fewer words than a shingle has its whole sequence as its one shingle; rows with a null id are kept and
link with nothing; rows of one id are one node, whatever their texts; ids that aren't whole numbers raise an error;
an empty table gives an empty result; only the named columns are read. Shingles are compared by 64-bit hashes: among n
shingles some n^2 / 2^65 pairs are expected to be equal by chance, which changes a confirmation only if they are of
the two texts compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_SHARES, LOWER, Scratch, batches, giving_back, inside_doc, mix, pieces, read_table, spread, text_bytes, window_hashes, word_hashes, words
from .graph import components

LANES, CHUNKS, BITS, THRESHOLD = 64, 16, 16, 28
WIDE = LANES // CHUNKS
#: Within a tile, pairs that differ in more than TRY of TRIED lanes are not tried: at similarity 0.8 that has probability
#: 1e-9. In tiles of up to SMALL texts all pairs are.
TRIED, TRY, SMALL = 32, 22, 8
#: A tile holds two parts of a component; a part has PART rows, more where there would be over MAX_PARTS, and some
#: PART_BYTES of text.
PART, MAX_PARTS, MAX_PART, PART_BYTES = 128, 16, 2048, 8 << 20
#: Rows of a key in a part of its tiles; bytes of text of the tiles that a task's function takes at once.
KEY_PART, BIN_BYTES = 2048, 8 << 20
#: A signature as numbers of 64 bits, a chunk each.
SIG = [f"s{c}" for c in range(CHUNKS)]

_rng = np.random.default_rng(20240501)
_LANE_MUL = _rng.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE_XOR = _rng.integers(1, 2**63, LANES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, ascending within each text, and where each text's begin."""
    w = words(LOWER[data], off)
    h, doc, docs = word_hashes(w), w.doc, len(off) - 1
    at = np.flatnonzero(inside_doc(w, n))
    parts, owners = [window_hashes(h, n)[at]], [doc[at]]
    for k in range(1, n):
        few = np.flatnonzero(w.counts == k)
        if len(few):
            parts.append(window_hashes(h, k)[w.first[few]] + np.uint64(k))
            owners.append(few)
    v, d = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    return v, np.searchsorted(d, np.arange(docs + 1))


def signatures(v: np.ndarray, at: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """BITS bits of the minimum of each lane, for every set; zeros for empty sets."""
    out = np.zeros((len(at) - 1, lanes), np.uint16)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        x = np.empty_like(v)
        for k in range(lanes):
            np.bitwise_xor(v, _LANE_XOR[k], out=x)
            np.multiply(x, _LANE_MUL[k], out=x)
            out[some, k] = mix(np.minimum.reduceat(x, at[some])) & np.uint64(0xFFFF)
    return out


def digests(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, from two sums of differently mixed hashes."""
    out = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        upto = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(mix(v ^ np.uint64(seed)), out=upto[1:])
        out.append(mix(upto[at[1:]] - upto[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def describe(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """_id, n_shingles, digest (two numbers), bytes of the text and signature (a number a chunk) of every text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in batches(it, "_text"):
            v, at = shingle_sets(data, off, shingle)
            sig = np.ascontiguousarray(signatures(v, at)).view(np.int64)
            columns = [batch.column(0), *(pa.array(x) for x in (np.diff(at), *digests(v, at), np.diff(off), *(np.ascontiguousarray(c) for c in sig.T)))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_shingles", "d1", "d2", "bytes", *SIG])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, ", ".join(f"{c} bigint" for c in ("_id", "n_shingles", "d1", "d2", "bytes", *SIG))
    )


def index_keys() -> Column:
    """The keys of a signature: for each chunk, the chunk without each of its lanes in turn. A chunk with
    no error shares all of these, one with an error in a lane shares that without the lane."""
    # as signed numbers
    without = [~(0xFFFF << BITS * j) if j < WIDE - 1 else (1 << BITS * j) - 1 for j in range(WIDE)]
    return F.array(*(F.xxhash64(F.lit(c * WIDE + j), F.col(SIG[c]).bitwiseAND(F.lit(without[j]))) for c in range(CHUNKS) for j in range(WIDE)))


def distance(a: str, b: str) -> Column:
    """In how many lanes two signatures (structs of SIG) differ."""
    low = sum(1 << BITS * j for j in range(WIDE))
    total = F.lit(0)
    for c in SIG:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for k in (8, 4, 2, 1):  # a lane's lowest bit becomes the OR of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(low)))
    return total


def near_signatures(rows: DataFrame) -> DataFrame:
    """Of rows (key, i, j, part, rep, sig, ok), the tiles of keys: a spanning forest (a, b) of the pairs within
    the threshold in each tile, other than pairs that are both `ok`."""

    @giving_back
    def run(table: pa.Table) -> pa.Table:
        ids, part = (np.asarray(table.column(c).cast(pa.int64()).combine_chunks()) for c in ("rep", "part"))
        sig = table.column("sig").combine_chunks()
        lanes = np.ascontiguousarray(np.stack([np.asarray(sig.field(c)) for c in SIG], 1)).view(np.uint16)
        ok = np.asarray(table.column("ok").combine_chunks())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets, links = _Sets(len(ids)), []
        one = np.flatnonzero(part == i)
        other = one if i == j else np.flatnonzero(part == j)
        for n, k in enumerate(one.tolist()):
            to = other[n + 1 :] if i == j else other
            to = to[~ok[to]] if ok[k] else to
            for x in to[(lanes[to] != lanes[k]).sum(1) <= THRESHOLD].tolist():
                a, b = sets.root(k), sets.root(x)
                if a != b:
                    sets.up[max(a, b)] = min(a, b)
                    links.append((int(ids[k]), int(ids[x])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def in_tiles(rows: DataFrame, parts: Column, by: Column) -> DataFrame:
    """Each row once for each part that its own (by a hash) meets: part, i, j."""
    own = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(by, F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


def candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) whose components hold all pairs of representatives within the threshold."""
    keyed = classes.select("rep", F.explode(index_keys()).alias("key"))
    # stored, so that adaptive execution can split the rows of a key that very many share
    shared = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n"))
    shared = scratch.put(shared.where("least <> most").select("key", "least", "n"), "shared")
    met = scratch.put(keyed.join(shared.hint("merge"), "key").where("rep <> least or n > 2").select("key", "rep", "least", "n"), "met")
    sig = classes.select("rep", F.struct(*SIG).alias("sig"))
    pairs = met.where("rep <> least").select("rep", "least").distinct()
    pairs = pairs.join(sig.hint("merge"), "rep").join(sig.toDF("least", "first").hint("merge"), "least")
    # an id may stand for more than one class
    pairs = scratch.put(pairs.groupBy("rep", "least").agg(F.bool_or(distance("sig", "first") <= THRESHOLD).alias("ok")), "pairs")
    stars = pairs.where("ok").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    far = pairs.where("not ok")
    several = met.where("n > 2").join(far.hint("merge"), ["rep", "least"], "left").select("key", "rep", "n", F.coalesce("ok", F.lit(True)).alias("ok"))
    mixed = scratch.put(several.where("not ok").select("key").distinct(), "mixed")
    rows = several.join(mixed.hint("merge"), "key", "left_semi").join(sig.hint("merge"), "rep")
    tiles = in_tiles(rows, F.ceil(F.col("n") / KEY_PART), F.xxhash64("rep"))
    return stars.union(near_signatures(tiles.select("key", "i", "j", "part", "rep", "sig", "ok")))


class _Sets:
    """Disjoint sets of row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def confirm(ids: np.ndarray, part: np.ndarray, cross: bool, v: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a tile's texts (of different parts only, if cross)."""
    n, size = len(ids), np.diff(at)
    sig = signatures(v, at, TRIED) if n > SMALL else np.zeros((n, 0), np.uint16)
    sets, links = _Sets(n), []
    # distances a row at a time keep memory at n * LANES
    a, b, far = [], [], []
    for i in range(n - 1):
        d = (sig[i + 1 :] != sig[i]).sum(1)
        small, large = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        ok = (d <= TRY) & (100 * small >= percent * large) & (small > 0) & (ids[i + 1 :] != ids[i])
        if cross:
            ok &= part[i + 1 :] != part[i]
        j = np.flatnonzero(ok) + i + 1
        a.append(np.full(len(j), i)), b.append(j), far.append(d[j - i - 1])
    if not a:
        return links
    a, b, far = (np.concatenate(x) for x in (a, b, far))
    for k in np.argsort(far, kind="stable"):
        i, j = int(a[k]), int(b[k])
        x, y = sets.root(i), sets.root(j)
        if x == y:
            continue
        p, q = v[at[i] : at[i + 1]], v[at[j] : at[j + 1]]
        both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
        if 100 * both >= percent * (len(p) + len(q) - both):
            sets.up[max(x, y)] = min(x, y)
            links.append((int(ids[i]), int(ids[j])))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept of every text. Linked: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    each = scratch.put(describe(docs, id_col, text_col, shingle), "each")
    known = each.where("n_shingles > 0 and _id is not null")
    classes = known.groupBy("d1", "d2").agg(F.min("_id").alias("rep"), F.max("bytes").alias("bytes"), *(F.min(c).alias(c) for c in SIG))
    classes = scratch.put(classes, "classes")
    cluster = scratch.put(components(candidates(classes, scratch), scratch, "candidates"), "clustered")
    for name in ("shared", "met", "pairs", "mixed"):
        scratch.drop(name)
    cluster = cluster.join(classes.select(F.col("rep").alias("node"), "bytes").hint("merge"), "node")
    size = F.least(F.greatest(F.lit(PART), F.ceil(F.col("n") / MAX_PARTS)), F.lit(MAX_PART))
    # stored, so that adaptive execution can split the rows of a large component
    sized = cluster.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("sum"))
    sized = scratch.put(sized.select("component", F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("sum") / PART_BYTES)).alias("wanted")), "sizes")
    own = cluster.join(sized.hint("merge"), "component")
    tiles = scratch.put(in_tiles(own, F.col("wanted"), F.xxhash64("node")).select("node", "component", "part", "i", "j", "bytes"), "tiles")
    bins = max(LEAST_SHARES, -(-(tiles.agg(F.sum("bytes")).first()[0] or 0) // BIN_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    # the same join at every size: a small table of tiles would else be broadcast, a large one not
    placed = texts.join(tiles.drop("bytes").hint("merge"), "node").withColumn("_bin", spread(bins, "component", "i", "j"))

    @giving_back
    def verify(table: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        keys = [np.asarray(table.column(c).cast(pa.int64()).combine_chunks()) for c in ("component", "i", "j")]
        order = np.lexsort((np.asarray(table.column("node").cast(pa.int64()).combine_chunks()), *keys[::-1]))
        if len(order):
            keys = [k[order] for k in keys]
            cut = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
            for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
                own = table.take(pa.array(order[lo:hi]))
                data, off = text_bytes(own.column("text"))
                made = [shingle_sets(data[off[x] : off[y]], off[x : y + 1] - off[x], shingle) for x, y in pieces(off)]
                v = np.concatenate([m[0] for m in made])
                at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(m[1]) for m in made]))])
                links += confirm(
                    np.asarray(own.column("node").combine_chunks()), np.asarray(own.column("part").combine_chunks()), keys[1][lo] != keys[2][lo], v, at, percent
                )
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    links = placed.groupBy("_bin").applyInArrow(verify, "a bigint, b bigint")
    # rows of one id are one node: its classes belong together
    several = known.groupBy("_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y"), F.min("d2").alias("z"), F.max("d2").alias("w")).where("x <> y or z <> w").select("_id")
    same = known.select("_id", "d1", "d2").join(several, "_id").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    linked = components(links.union(same), scratch, "links")
    final = classes.select("d1", "d2", F.col("rep").alias("node")).join(linked, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    out = each.join(final, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "_id")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNotNull(), component)
    return out.select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept")
    )


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)
), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
