import random

import numpy as np
import pyarrow as pa

from quern.llm import p06_neardup as p
from quern.llm._components import connected_components

LETTERS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜"


def records(seed=5, n=60):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        t = "".join(rnd.choice(LETTERS) for _ in range(60))
        rows.append((4 * k, t))
        rows.append((4 * k + 1, t[:20] + rnd.choice("甲乙") + t[21:] + "！"))
        if k % 3 == 0:
            rows.append((4 * k + 2, t[30:] + "，" + t[:30]))
        if k % 5 == 0:
            rows.append((4 * k + 3, " ".join(t) + "？"))
    return rows


def brute(rows):
    texts = {i: t for i, q in rows if i is not None and (t := p.normal(q))}
    return {(a, b) for a in texts for b in texts if a < b and p.jaccard(texts[a], texts[b]) >= p.SIMILAR}


def test_components_against_brute_force(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_pairs_and_groups(spark):
    rows = records()
    odd = [(900, None), (901, ""), (902, "短"), (903, rows[0][1]), (903, rows[0][1]), (None, rows[0][1]), (904, "ab" * 40000), (905, "！？" * 30)]
    df = spark.createDataFrame([(i, q, "clash") for i, q in rows + odd], "id long, question string, node string")
    assert {tuple(r) for r in p.similar_pairs(df).collect()} == brute(rows + odd)
    got = {r.id: (r.group_id, r.links) for r in p.groups(df).collect()}
    assert got[0][0] == got[1][0] == got[903][0] == 0 and got[904] == (904, 0) and 900 not in got and len(got) == len(rows) + 2
    assert p.similar_pairs(df.limit(0)).count() == 0 and p.groups(df.limit(0)).count() == 0


def test_crowded_buckets_lose_no_member():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 3)
    bits = np.concatenate([b ^ (1 << rnd.integers(0, 60, 400)) for b in base]).astype(np.int64)
    bits = np.stack([bits, bits], axis=1)
    nodes = np.arange(len(bits))
    pairs = np.concatenate(p.link_bucket(nodes, bits), axis=1)
    root = list(range(len(bits)))
    for a, b in pairs.T:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    for k in range(3):
        part = range(400 * k, 400 * (k + 1))
        ends = set()
        for x in part:
            while root[x] != x:
                x = root[x]
            ends.add(x)
        assert len(ends) == 1


def test_sketches_estimate_weighted_similarity():
    weights = np.ones(p.TABLE)
    rows = [q for _, q in records(seed=9, n=40)]
    texts = [t for q in rows if (t := p.normal(q))]
    sketch = p.dart_sketches(texts, weights)
    gaps = [(sketch[k] == sketch[k + 1]).mean() - p.jaccard(texts[k], texts[k + 1]) for k in range(len(texts) - 1)]
    assert abs(np.mean(gaps)) < 0.04 and np.abs(gaps).max() < 0.3
    assert (p.dart_sketches(texts[:5], weights) == sketch[:5]).all()


def edited_copies(rnd, n, length=60, edit=3):
    """Copies of one text, each with its own rare edit."""
    base = "".join(rnd.choice(LETTERS) for _ in range(length))
    out = []
    for _ in range(n):
        at = rnd.randrange(length - edit)
        out.append(base[:at] + "".join(chr(rnd.randrange(0x5000, 0x9000)) for _ in range(edit)) + base[at + edit :])
    return out


def test_a_third_of_the_rows_are_edited_copies(spark):
    rnd = random.Random(11)
    texts = edited_copies(rnd, 200) + ["".join(chr(rnd.randrange(0x5000, 0x9000)) for _ in range(60)) for _ in range(400)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, question string")
    want = brute(rows)
    own, nodes = p.members_and_texts(df)
    id_of = {r.node: r.id for r in own.collect()}
    met = {tuple(sorted((id_of[r.u], id_of[r.v]))) for r in p.similar_nodes(nodes).collect()}
    assert met <= want
    assert len(met) > 0.75 * len(want)
    assert {tuple(r) for r in p.similar_pairs(df).collect()} == want


def test_crowded_buckets_compare_all_members(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    bits = np.bitwise_xor.reduce((1 << rnd.integers(0, 56, (40, 2, 14))).astype(np.int64), axis=2)
    nodes = np.arange(40, dtype=np.int64)
    differ = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(bits[a], bits[b]))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if differ(a, b) <= p.BITS - p.AGREE}
    met = lambda: pa.Table.from_batches(p._pairs(iter([p._rows(np.full(40, 7), nodes, bits)])))
    assert {(r["u"], r["v"]) for r in met().to_pylist()} == want and 0 < len(want) < 780
    monkeypatch.setattr(p, "CROWDED", 8)
    crowd = [(r["u"], r["key"], r["bits"], r["more"]) for r in met().to_pylist()]
    assert {tuple(r) for r in p.crowded_pairs(spark.createDataFrame(crowd, "u long, key long, bits long, more long")).collect()} == want


def test_links_count_every_alike_text_of_a_large_group(spark):
    rnd = random.Random(11)
    texts = edited_copies(rnd, 200) + ["".join(chr(rnd.randrange(0x5000, 0x9000)) for _ in range(60)) for _ in range(400)]
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {r.id: r.links for r in p.groups(spark.createDataFrame(rows, "id long, question string")).collect()}
    assert got == {i: sum(i in pair for pair in want) for i, _ in rows}


def test_long_chain_is_extended_exactly(spark):
    # a window that moves over a long text: each record is alike to its near neighbours only
    rnd = random.Random(7)
    line = "".join(rnd.choice(LETTERS) for _ in range(400))
    rows = [(k, line[5 * k : 5 * k + 60]) for k in range(66)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "id long, question string")
    assert {tuple(r) for r in p.similar_pairs(df).collect()} == want
    sets = spark.createDataFrame([(1, k, p.normal(t)) for k, t in rows], "component long, node long, text string")
    near = {tuple(r) for r in p.prefix_pairs(sets).collect()}
    assert want <= near and len(near) < 66 * 65 / 4


def test_texts_with_equal_names_stay_apart(spark, monkeypatch):
    names = p.names
    monkeypatch.setattr(p, "names", lambda t: (7 if t.startswith("clash") else names(t)[0], names(t)[1]))
    texts = p._texts(frozenset([7]))
    a, b = "clash" + "a" * 30, "clash" + "b" * 30
    out = pa.Table.from_batches(texts(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([a, b, a])], ["id", "q"])]))).to_pylist()
    assert {r["node"] for r in out} == {names(a)[1], names(b)[1]} and {r["text"] for r in out} == {a, b}
    own = pa.Table.from_batches(p._members(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a, b])], ["id", "q"])]))).to_pylist()
    assert [r["node"] for r in own] == [7, 7] and own[0]["second"] != own[1]["second"]
