"""Problem 6: near-duplicate records with small edits.

A question's set holds its runs of three letters or digits, all of one weight, as the
similarity asked for is that of the plain sets: runs weighted by rarity would hide the
members of a large group, whose shared runs are common, from each other.
DartMinHash throws hashed darts into every run's region and keeps the earliest dart of
each coordinate; questions that share the coordinates of a band meet in a bucket.
There, one bit of every coordinate gives a quick estimate; what passes is checked exactly
against the Jaccard similarity of the plain sets. Verified pairs form components. Inside a component the remaining
alike pairs are found exactly: small components pair by pair, larger ones by a join on the
prefix of each set's runs, rarest first, which two alike sets can't but share. So a pair
missed by every band is found through a common neighbour, and a long chain of edits costs
no more than its near pairs.

Exact copies (after normalisation) are one node throughout and are only multiplied at the
end, where all pairs are asked for. A node is named by a 64-bit hash; a second hash shows
where two texts got the same name, and these are named by the second one. Questions that are null, blank or shorter than
`MIN_CHARS` after normalisation are out. A record that comes again counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._components import connected_components
from quern.llm._text import joined, letters_and_digits, mix64
from quern.session import cut_lineage
from quern.sources.tables import table

RUN, MIN_CHARS, SIMILAR = 3, 20, 0.6
BANDS, ROWS = 28, 4
COORDINATES = BITS = BANDS * ROWS
TABLE = 1 << 20
#: Equal bits (of BITS, one each of as many coordinates) from which a pair is checked exactly: a pair at SIMILAR has 90 and
#: stays under 76 once in 2,000 cases (its group may find it then). Buckets up to CROWDED are
#: compared in one task; larger ones are spread over SALTS.
AGREE, CROWDED = 76, 1_024
#: Components up to this size are paired directly, larger ones joined on prefixes; crowded buckets are spread over SALTS.
LARGE, SALTS = 24, 32


def normal(question: str | None) -> str | None:
    """Letters and digits after NFKC and lower case; None for questions that are out."""
    if not question:
        return None
    out = letters_and_digits(question)
    return out if len(out) >= MIN_CHARS else None


def names(text: str) -> tuple[int, int]:
    """Two independent 64-bit hashes of a text."""
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return tuple(v - (1 << 64) if v >> 63 else v for v in (h & 0xFFFFFFFFFFFFFFFF, h >> 64))


def node(text: str, clashes: frozenset[int] = frozenset()) -> int:
    a, b = names(text)
    return b if a in clashes else a


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, packed run) for every position of every text."""
    points, starts = joined(texts)
    p = points.astype(np.uint64)
    packed = (p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[:-2]
    ends = np.zeros(len(points), dtype=bool)
    ends[starts[1:] - 1] = True
    inside = ~(ends[:-2] | ends[1:-1] | ends[2:])
    return owner[inside], packed[inside]


def _bucket(packed: np.ndarray) -> np.ndarray:
    return (mix64(packed) >> np.uint64(44)).astype(np.int64)


def dart_sketches(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) of the earliest dart in each coordinate, rank above identity in 64 bits.

    A run with weight w receives darts at rate w along the rank axis; its d-th dart, its
    rank and its coordinate follow from hashes of (run, d) alone, so that equal runs throw
    equal darts in every task. Darts are thrown up to a rank that fills all coordinates of
    most texts; for the rest the rank is doubled.
    """
    owner, packed = runs_of(texts)
    grams, at = np.unique(packed, return_inverse=True)
    seed, w = mix64(grams), weights[_bucket(grams)]
    total = np.bincount(owner, weights=w[at], minlength=len(texts))
    out = np.full(len(texts) * COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    todo, reach = np.arange(len(texts)), COORDINATES * (np.log(COORDINATES) + 2.5) / max(float(np.median(total)), 1e-9)
    while len(todo):
        chosen = np.zeros(len(texts), dtype=bool)
        chosen[todo] = True
        mine = chosen[owner]
        occ_owner, occ_gram = owner[mine], at[mine]
        rank, dart = np.zeros(len(grams)), 0
        live = np.unique(occ_gram)
        while len(live):
            dart += 1
            h = mix64(seed[live] + np.full(1, dart, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rank[live] -= np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[live]
            g = mix64(h)
            value = np.zeros(len(grams), dtype=np.uint64)
            coordinate = np.zeros(len(grams), dtype=np.int64)
            value[live] = (np.minimum(rank[live] * 2.0**22, 2.0**38 - 1).astype(np.uint64) << np.uint64(26)) | (g & np.uint64((1 << 26) - 1))
            coordinate[live] = ((g >> np.uint64(32)) % np.uint64(COORDINATES)).astype(np.int64)
            near = rank[occ_gram] <= reach
            occ_owner, occ_gram = occ_owner[near], occ_gram[near]
            np.minimum.at(out, occ_owner * COORDINATES + coordinate[occ_gram], value[occ_gram])
            live = live[rank[live] <= reach]
        todo = todo[(out.reshape(len(texts), COORDINATES)[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach *= 2
        if reach > 2.0**15:  # only for texts of runs with next to no weight
            break
    return out.reshape(len(texts), COORDINATES)


def bands_and_bits(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, BANDS) and one bit of each coordinate packed into two int64 (texts, 2)."""
    key = np.full((len(sketch), BANDS), 7, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r::ROWS])
    parity = mix64(sketch.ravel()).reshape(sketch.shape) & np.uint64(1)
    half = BITS // 2
    bits = np.stack([(part << np.arange(half, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for part in (parity[:, :half], parity[:, half:])], axis=1)
    return key.view(np.int64), bits.view(np.int64)


def _equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return BITS - np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64).sum(axis=-1)


def link_bucket(nodes: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Pairs (2, n) of a bucket that agree in enough bits, every member compared with every other; nodes are distinct."""
    out = []
    while len(nodes) > 1:
        pair = _equal_bits(bits[1:], bits[:1]) >= AGREE
        if pair.any():
            out.append(np.stack([np.full(int(pair.sum()), nodes[0]), nodes[1:][pair]]))
        nodes, bits = nodes[1:], bits[1:]
    return out


def _runs_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return cut, np.diff(np.r_[cut, len(keys)])


def _rows(key: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in (key, nodes, bits[:, 0], bits[:, 1])], ["key", "node", "bits", "more"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = np.ones(TABLE)
    for batch in batches:
        nodes, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for a in range(0, len(texts), 4096):
            keys, bits = bands_and_bits(dart_sketches(texts[a : a + 4096], w))
            yield _rows(keys.ravel(), np.repeat(nodes[a : a + 4096], BANDS), np.repeat(bits, BANDS, axis=0))


def _met(*columns: np.ndarray | None) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["u", "v", "key", "bits", "more"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (u, v) of rows that come sorted by key; a bucket may go on in the next batch.

    The members of a crowded bucket are handed on instead, as u with key and bits and without v.
    """
    held = [np.zeros(0, dtype=np.int64)] * 4

    def emit(key, nodes, *words):
        bits = np.stack(words, axis=1)
        start, size = _runs_of_equal(key)
        found, crowd = [], []
        two = np.flatnonzero(size == 2)  # the common case at once
        a, b = start[two], start[two] + 1
        ok = (_equal_bits(bits[a], bits[b]) >= AGREE) & (nodes[a] != nodes[b])
        found.append(np.stack([nodes[a[ok]], nodes[b[ok]]]))
        for s, n in zip(start[size > 2], size[size > 2]):
            own, first = np.unique(nodes[s : s + n], return_index=True)
            if len(own) > CROWDED:
                crowd.append((own, np.full(len(own), key[s]), bits[s : s + n][first]))
            else:
                found += link_bucket(own, bits[s : s + n][first])
        both = np.concatenate(found, axis=1)
        yield _met(both.min(axis=0), both.max(axis=0), None, None, None)
        for own, at, b in crowd:
            yield _met(own, None, at, np.ascontiguousarray(b[:, 0]), np.ascontiguousarray(b[:, 1]))

    for batch in batches:
        cols = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[last:] for c in cols]
        if last:
            yield from emit(*(c[:last] for c in cols))
    if len(held[0]):
        yield from emit(*held)


def _texts(clashes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[int, str] = {}
            for key, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = normal(q) if key is not None else None
                if t is not None:
                    kept[node(t, clashes)] = t
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.string())], ["node", "text"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nodes, seconds = [], [], []
        for key, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = normal(q) if key is not None else None
            if t is not None:
                a, b = names(t)
                ids.append(key)
                nodes.append(a)
                seconds.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(seconds, pa.int64())], ["id", "node", "second"])


def run_set(t: str) -> set[str]:
    return {t[k : k + RUN] for k in range(len(t) - RUN + 1)}


def share(x: set[str], y: set[str]) -> float:
    same = len(x & y)
    return same / (len(x) + len(y) - same)


def jaccard(a: str, b: str) -> float:
    return share(run_set(a), run_set(b))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, a, b = (batch.column(k).to_pylist() for k in range(4))
        sets: dict[int, set[str]] = {}
        for key, t in chain(zip(u, a), zip(v, b)):
            if key not in sets:
                sets[key] = run_set(t)
        keep = [k for k in range(len(u)) if share(sets[u[k]], sets[v[k]]) >= SIMILAR]
        yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64())], ["u", "v"])


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose texts are alike, checked exactly."""
    full = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return full.select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long")


def crowded_pairs(crowd: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, that agree in enough bits, of all members (u, key, bits, more) of crowded buckets; a bucket is spread over salts."""
    a = crowd.select("key", "u", F.col("bits").alias("x"), F.col("more").alias("p"), F.pmod("u", F.lit(SALTS)).cast("int").alias("salt"))
    b = crowd.select("key", F.col("u").alias("v"), F.col("bits").alias("y"), F.col("more").alias("q"), F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) + F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= BITS - AGREE
    return a.join(b, ["key", "salt"]).where(F.col("u") < F.col("v")).where(near).select("u", "v")


def similar_nodes(texts: DataFrame) -> DataFrame:
    """Verified pairs (u, v), u < v, of the nodes of `texts(node, text)` that met in a bucket."""
    rows = texts.select("node", "text").mapInArrow(_sketch, "key long, node long, bits long, more long")
    met = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "u long, v long, key long, bits long, more long").distinct())
    pairs, crowd = met.where("v is not null").select("u", "v"), met.where("v is null")
    if not crowd.isEmpty():
        pairs = cut_lineage(pairs.union(crowded_pairs(crowd)).distinct())
    return cut_lineage(_alike(pairs, texts))


def members_and_texts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) of the records `records(id, question)` that take part, and (node, text), each text once."""
    records = records.select(F.col("id").cast("long"), "question")
    own = cut_lineage(records.mapInArrow(_members, "id long, node long, second long").distinct())
    twice = own.groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    clashes = frozenset(r.node for r in twice.select("node").collect())  # n * n / 2 ** 65 are expected among n texts
    named = F.when(F.col("node").isin(list(clashes)), F.col("second")).otherwise(F.col("node")) if clashes else F.col("node")
    texts = cut_lineage(records.mapInArrow(_texts(clashes), "node long, text string").dropDuplicates(["node"]))
    return own.select("id", named.alias("node")), texts


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of nodes of one component of `sets(component, node, text)` that can be alike; no alike pair is missing.

    Runs are ordered by their number in the component. Of two sets with at least SIMILAR of
    their union in common, the prefixes of n - ceil(SIMILAR * n) + 1 runs share one.
    """
    runs = F.expr(f"array_distinct(transform(sequence(1, length(text) - {RUN - 1}), i -> substring(text, i, {RUN})))")
    each = sets.select("component", "node", F.explode(runs).alias("run"))
    seen = each.groupBy("component", "run").agg(F.count("*").alias("often"))
    ordered = each.join(seen, ["component", "run"]).groupBy("component", "node").agg(F.sort_array(F.collect_list(F.struct("often", "run"))).alias("runs"))
    n = F.size("runs")
    prefix = F.slice("runs", F.lit(1), (n - F.ceil(n * SIMILAR - 1e-9) + 1).cast("int"))
    lead = ordered.select("component", "node", n.alias("n"), F.explode(F.transform(prefix, lambda r: r["run"])).alias("run"))
    a = lead.select("component", "run", F.col("node").alias("u"), F.col("n").alias("x"))
    b = lead.select("component", "run", F.col("node").alias("v"), F.col("n").alias("y"))
    near = a.join(b, ["component", "run"]).where((F.col("u") < F.col("v")) & (F.least("x", "y") >= F.greatest("x", "y") * SIMILAR - 1e-9))
    return near.select("u", "v").distinct()


def _within(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of nodes of one component, u < v, that can be alike."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 2")
    sized = parts.join(sizes, "component")
    few, many = sized.where(F.col("n") <= LARGE), sized.where(F.col("n") > LARGE)
    small = few.select("component", F.col("node").alias("u")).join(few.select("component", F.col("node").alias("v")), "component").where("u < v").select("u", "v")
    if many.isEmpty():
        return small
    return small.union(prefix_pairs(many.select("component", "node").join(texts, "node")))


def _alike_nodes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs (u, v) of alike nodes, those that met in a bucket and the others inside components, and (node, component)."""
    edges = similar_nodes(texts)
    parts = cut_lineage(connected_components(edges))
    more = cut_lineage(_alike(_within(parts, texts).join(edges, ["u", "v"], "left_anti"), texts))
    return edges.union(more), parts


def groups(records: DataFrame) -> DataFrame:
    """(id, group_id, links): one row a record; links counts the different texts it is directly alike to.

    A group is named by its least record id; a record without partner is its own group.
    """
    own, texts = members_and_texts(records)
    found, parts = _alike_nodes(texts)
    links = found.select(F.col("u").alias("node")).union(found.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    # by node first: a text that a third of all records share is one row there
    nodes = own.groupBy("node").agg(F.min("id").alias("least")).join(parts, "node", "left").join(links, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    nodes = cut_lineage(nodes)
    name = nodes.groupBy("component").agg(F.min("least").alias("group_id"))
    named = nodes.join(name, "component").select("node", "group_id", "links")
    return own.join(named, "node").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))


def similar_pairs(records: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b) of different records that are alike, exact copies included."""
    own, texts = members_and_texts(records)
    found, _ = _alike_nodes(texts)
    ids = own.groupBy("node").agg(F.count("*").alias("n"))
    copies = own.join(ids.where("n > 1").select("node"), "node", "left_semi")
    same = copies.select("node", F.col("id").alias("x")).join(copies.select("node", F.col("id").alias("y")), "node").where("x < y").select("x", "y")
    apart = found.join(own.select(F.col("node").alias("u"), F.col("id").alias("x")), "u").join(own.select(F.col("node").alias("v"), F.col("id").alias("y")), "v").where("x <> y").select("x", "y")
    return same.union(apart).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _records(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "format_data", ["id", "question"])
    return a.unionByName(table(spark, folder, "deepseek_qa", ["qa_id", "question"]).withColumnRenamed("qa_id", "id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(_records(spark, folder))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Group and number of links of every record."""
    return groups(_records(spark, folder))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
ORACLES: dict[str, str] = {}
