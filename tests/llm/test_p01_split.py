import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import p01_split as p


def brute(text, limit, overlap):
    """The same rule by plain scanning."""
    s = p.boundary_strengths(p.code_points(text)).tolist()
    out, start, n = [], 0, len(text)
    while n - start > limit:
        low, high = start + overlap + 1, start + limit
        upper = max(low, start + (limit + 1) // 2)
        f, at = max((s[k], k) for k in range(upper, high + 1))
        if f < p.SENTENCE and low < upper:
            g, w = max((s[k], k) for k in range(low, upper))
            if g >= p.SENTENCE or g > f == 0:
                f, at = g, w
        if f < 0:
            f, at = 0, high
        out.append((start, at, f))
        start = at - overlap
    return [*out, (start, n, p.PARAGRAPH)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab1. \n\r。，！”😀́‍", min_size=0, max_size=400), st.integers(2, 60), st.integers(0, 20))
def test_spans_against_brute_force_and_round_trip(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = p.spans(text, limit, overlap)
    assert got == (brute(text, limit, overlap) if len(text) > limit else [(0, len(text), p.PARAGRAPH)])
    assert all(0 < b - a <= limit or len(text) == 0 for a, b, _ in got)
    assert text == text[got[0][0] : got[0][1]] + "".join(text[a + overlap : b] for a, b, _ in got[1:])
    assert all(c == b - overlap for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_boundaries():
    s = lambda t: p.boundary_strengths(p.code_points(t)).tolist()
    assert s("a\n\nb")[3] == p.PARAGRAPH and s("a\nb")[2] == p.LINE and s("a\r\nb")[3] == p.LINE and s("a\r\n\r\nb")[5] == p.PARAGRAPH
    assert s("好。”他")[3] == p.SENTENCE and s("好。”他")[2] == 0
    assert s("3.14 x")[2] == 0 and s("x\n3. y")[4] == 0 and s("ok. y")[3] == p.SENTENCE
    assert s("") == [0]


def test_long_text_without_boundaries_crosses_blocks():
    text = "x" * (p.BLOCK + 5000)
    got = p.spans(text, 2000, 120)
    assert all(b - a <= 2000 for a, b, _ in got) and got[-1][1] == len(text)
    random.seed(1)
    text = "".join(random.choice("ab。\n ") for _ in range(p.BLOCK + 3000))
    assert p.spans(text, 1000, 50) == brute(text, 1000, 50)


def test_rows(spark):
    rows = [("t", 1, "x" * 5), ("t", 2, "ab。cd。ef"), ("t", 2, "ab。cd。ef"), ("t", 3, None), ("t", 4, ""), ("t", None, "y" * 9), ("u", 1, "z" * 99)]
    items = spark.createDataFrame([(*r, "extra") for r in rows], "tbl string, item_id long, text string, max_chars string")
    limits = spark.createDataFrame([("t", 5, 1, "v"), ("v", None, None, "v")], "tbl string, max_chars int, overlap_chars int, text string")
    got = [tuple(r) for r in p.split_items(items, limits).select("tbl", "item_id", "piece").collect()]
    assert sorted((k for _, k, _ in got), key=lambda k: (k is None, k)) == [2, 2, 2, None, None]
    assert {t for _, k, t in got if k == 2} == {"ab。", "。cd。", "。ef"} and all(len(t) <= 5 for *_, t in got)
    assert p.split_items(items.limit(0), limits).count() == 0
    assert p.split_items(items, limits.limit(0)).count() == 0


def test_found(spark, data):
    found = p.p1_found(spark, data)
    assert found.columns == ["tbl", "item_id"] and found.count() == found.distinct().count() > 0
    pieces = p.p1_pieces(spark, data)
    assert pieces.where("length(piece) > 2000 or length(piece) <> stop - start").count() == 0
