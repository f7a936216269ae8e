import random

from quern.llm import p07_leaks as p


def test_automaton_against_brute_force():
    rnd = random.Random(3)
    items = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 25))] for _ in range(12)]
    sam = p.SuffixAutomaton(items)
    for _ in range(60):
        doc = [rnd.randrange(4) for _ in range(40)]
        got = sam.matches(doc, 2)
        ends = []
        for end in range(len(doc)):
            run = 0
            for n in range(1, end + 2):
                if any(doc[end - n + 1 : end + 1] == it[k : k + n] for it in items for k in range(len(it) - n + 1)):
                    run = n
            ends.append(run)
        want = [(k, r) for k, r in enumerate(ends) if r >= 2 and (k + 1 == len(doc) or ends[k + 1] <= r)]
        assert [(e, r) for e, r, _ in got] == [(k, r) for k, r in want if k + 1 == len(doc) or ends[k + 1] != r + 1]
        for e, r, s in got:
            places = {(i, k + r - 1) for i, it in enumerate(items) for k in range(len(it) - r + 1) if it[k : k + r] == doc[e - r + 1 : e + 1]}
            assert set(sam.where(s)) == places


ITEM = "春节前复诊显示颈椎曲度短暂缓解，晨间读数降至123.79。目前尚无证据表明维喏培能改善腰椎间盘，因此仍以足弓塌陷管理为主。"
OTHER = "The nurse will record every change of the reading, and the doctor decides in autumn whether another visit is needed at all."


def test_rows(spark):
    swapped = "".join("某" if k % 11 == 5 and "一" <= c <= "龥" else c for k, c in enumerate(ITEM))
    docs = [
        (1, "前文。" + ITEM + "后文。"), (2, "A B " + OTHER.upper().replace(" ", "\n")), (3, " ".join(ITEM)), (4, swapped), (5, ITEM[:12] + "别的内容在这里继续说下去。"), (6, None), (7, ""),
        (8, "x " * 50000 + ITEM[20:]), (9, "".join(chr(0xFEE0 + ord(c)) if "!" <= c <= "~" else c for c in OTHER)), (1, "前文。" + ITEM + "后文。"), (10, "。".join(ITEM[k : k + 7] + "其他内容写在中间若干字数" for k in range(0, 50, 7))),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(70, ITEM, 1), (71, ITEM, 1), (72, OTHER, 1), (73, None, 1), (74, "", 1), (75, "短", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in p.leaks(df, items).collect()}
    assert got == {(d, i) for d in (1, 3, 4, 8) for i in (70, 71)} | {(2, 72), (9, 72)}
    clean = {r.doc_id: r.text for r in p.without_leaks(df, items).collect()}
    assert clean[1] == "前文。。后文。" and clean[5] == docs[4][1] and clean[6] is None and clean[7] == "" and "nurse" not in clean[2].lower()
    assert p.leaks(df.limit(0), items).count() == 0 and p.leaks(df, items.limit(0)).count() == 0


def test_tables(spark, data):
    found = p.p7_found(spark, data)
    assert found.columns == ["doc_id", "item_id"] and found.count() == found.distinct().count() > 0


def test_many_altered_copies_in_one_document():
    item = " ".join(f"word{k}" for k in range(30))
    altered = " ".join("other" if k % 10 == 9 else f"word{k}" for k in range(30))
    items = p.Items([(1, item)])
    once, often = (p.leaks_in(" filler text between copies of it ".join([altered] * n), items) for n in (1, 60))
    assert [r[0] for r in once] == [0] and often[0][3] == once[0][3] > 0.85
    # a phrase of the item that stands often before the leak
    assert p.leaks_in("word0 word1 word2 word3 word4 x y z " * 60 + altered, items)[0][3] == once[0][3]


def test_stored_text_stays(monkeypatch):
    text = "Dr. Smith, ﬁrst floor, MONDAY re-\nading Ⅻ.\n" + "THE nurse will rec-\nord every change of the READING, and the doctor decides in autumn whether another visit is needed at all." + "\nCafe\u0301 “Ｆｕｌｌ” stays"
    items = p.Items([(1, OTHER)])
    assert p.remove_leaks(text, [items]) == "Dr. Smith, ﬁrst floor, MONDAY re-\nading Ⅻ.\n.\nCafe\u0301 “Ｆｕｌｌ” stays"
    for t in (text, "plain ASCII cut-\nting", "가각 e\u0301ﬃ ｶﾞ half", ITEM, ""):
        assert [w for w, *_ in p.placed_tokens(t)] == p.tokens_of(t)
    rows = [(1, OTHER), (2, ITEM)]
    assert [len(s) for s in p.shards_of(rows, 5)] == [1, 1] and p.shards_of(rows, 10**6) == [rows] and p.shards_of([], 5) == []


def test_passage_inside_a_longer_match_of_another_item():
    shared = " ".join(f"s{k}" for k in range(12))
    items = p.Items([(1, "a1 a2 a3 a4 a5 a6 a7 " + shared + " b1 b2 b3 b4 b5 b6 b7"), (2, "c1 c2 " + shared + " d1 d2"), (3, "e1 e2 e3 e4 e5 e6")])
    found = p.leaks_in("x y a5 a6 a7 " + shared + " b1 b2 z", items)
    assert {items.ids[i][0] for i, *_ in found} == {1, 2}
