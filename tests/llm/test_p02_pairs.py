import numpy as np
import pyarrow as pa

from quern.llm import p02_pairs as p

SCHEMA = "id long, question string, answer string, defect string"
GOOD = ["每天记录一次读数，并在第%d周复查一次。" % k for k in range(40)] + ["Please keep a diary and call after %d days." % k for k in range(40)]


def counts(texts):
    table = np.zeros(p.OFFSETS[-1], dtype=np.int64)
    p._fill_ends(pa.RecordBatch.from_arrays([pa.array(texts)], ["a"]), table)
    return table


def test_end_counts_against_brute_force():
    texts = ["ab12。ab12x", "", None, "zzab3.5 ab 7."]
    table = counts(texts)
    n, size = p.ORDERS[0], 1 << p.BITS[0]
    stream = "".join(t + "\x00" for t in texts if t)
    want, ended = {}, {}
    keep, flat = [], ""
    for i, ch in enumerate(stream):
        if not (ch.isdigit() and stream[i + 1 : i + 2].isdigit()):
            flat += "0" if ch.isdigit() else ch
            nxt, after = stream[i + 1 : i + 2], stream[i + 2 : i + 3]
            keep.append(nxt in set("。！？!?…；;\n\x00") | {""} or nxt == "." and after in set(" \t\r\n\x00　") or ch == "." and nxt in set(" \t\r\n\x00　"))
    for i in range(n, len(flat)):
        g = flat[i - n : i]
        want[g] = want.get(g, 0) + 1
        ended[g] = ended.get(g, 0) + keep[i - 1]
    for g, k in want.items():
        for j, h in enumerate(p._context_hashes(np.array([ord(c) for c in g], dtype=np.uint64), 0)):
            b = 2 * j * size + h[n]
            assert table[b] >= k and table[b + size] >= ended[g]
    assert table[:size].sum() == sum(want.values()) and table[size : 2 * size].sum() == sum(ended.values())


def test_language_model_on_held_out_text():
    held = {
        "zh": "护士会在早上来看您，请不要担心。", "en": "The nurse is going to see you in the morning, do not worry.", "ja": "朝に看護師が来ますので、心配しないでください。",
        "ru": "Утром придёт медсестра, не беспокойтесь об этом.", "de": "Am Morgen kommt die Schwester, machen Sie sich keine Sorgen.", "es": "Por la mañana vendrá la enfermera, no se preocupe por eso.",
        "fr": "Une infirmière viendra vous voir le matin, ne vous inquiétez pas.", "ko": "아침에 간호사가 올 것이니 걱정하지 마세요.",
        "vi": "Sáng mai y tá sẽ đến thăm bạn, xin đừng lo lắng.", "tr": "Sabah hemşire sizi görmeye gelecek, merak etmeyin.", "pl": "Rano przyjdzie pielęgniarka, proszę się nie martwić.", "id": "Perawat akan datang pada pagi hari, jangan khawatir.",
    }
    scores, letters = p.language_scores([*held.values(), ""], p.train_languages())
    assert [p.LANGUAGES[k] for k in scores[:-1].argmax(axis=1)] == list(held) and letters[-1] == 0


def test_rules():
    assert all(p.is_empty(a) for a in (None, "", " \n", "。", "N/A", "（空）", "无", "none", "...", "　　"))
    assert not p.is_empty("无需治疗") and not p.is_empty("x" * 100)
    assert p.is_refusal("抱歉，我无法回答这个问题，谢谢理解。") and p.is_refusal("I'm sorry, but I cannot help with that request; try another question.")
    assert not p.is_refusal("虽然目前无法完全排除其他原因，但应每日记录一次读数，并在第三周复查一次，必要时调整剂量。")
    assert not p.is_refusal("抱歉让您久等，请每天记录一次。")
    q = "家里老人今年八十岁，夜里咳嗽三天了，要不要先查一下胸片？"
    assert p.is_copy(q, q) and p.is_copy(q, "您问的是：" + q) and p.is_copy(q, q + "\n" + q)
    assert not p.is_copy(q, q + "先观察三天，如果发热就去医院做检查，平时多喝水。") and not p.is_copy("", "x")


def test_long_texts_are_read_to_their_end():
    q = "家里老人今年八十岁，夜里咳嗽三天了，要不要先查一下胸片？"
    spaced = (" " * 20).join(q)
    assert p.is_copy(q, spaced) and p.is_copy(q, q + "\n" * 2000 + q) and not p.is_copy(q, q + "先观察三天。" * 200)
    assert p.is_refusal("抱歉，我无法回答这个问题。" * 80) and not p.is_refusal("抱歉，我无法回答这个问题。" * 80 + "请每天记录一次读数，并在第三周复查一次，必要时由医生调整剂量和用法。")
    table = counts(GOOD)
    assert p.is_truncated("先观察（见" + "每天记录读数和感受" * 60 + "一次", table)


def test_truncation():
    table = counts(GOOD)
    assert not p.is_truncated("每天记录一次读数，并在第7周复查一次", table)
    for cut in ("每天记录一次读数，", "每天记录一次读数，并在第", "先观察。\n2.", "先观察。例如：", "先观察（见", "并在第…", "Please keep a diary and", "1. a\n2、"):
        assert p.is_truncated(cut, table), cut
    for whole in ("先观察。", "他说“好。”", "Done!"):
        assert not p.is_truncated(whole, table)


def test_rows(spark):
    good = [(100 + k, "需要注意什么？", g, "x") for k, g in enumerate(GOOD)]
    q = "家里老人今年八十岁，夜里咳嗽三天了，要不要先查一下胸片？"
    odd = [
        (1, q, None, None), (1, q, None, None), (2, None, "无", None), (3, q, q, None), (4, q, "The nurse is going to see you in the morning, do not worry.", None), (5, "why?", GOOD[3], None),
        (6, q, "每天记录一次读数，并在第", None), (7, None, GOOD[1], None), (None, q, "", None), (8, q, "很抱歉，恕我不便作答。", None), (9, q, GOOD[2] * 20000, None),
    ]
    df = spark.createDataFrame(good + odd, SCHEMA)
    got = {r.id: r.defect for r in p.pair_defects(df).collect()}
    assert got == {1: "empty", 2: "empty", 3: "copy", 4: "language", 6: "truncated", None: "empty", 8: "refusal"}
    assert p.pair_defects(df.limit(0)).count() == 0


def test_found(spark, data):
    found = p.p2_found(spark, data)
    assert found.columns == ["id", "defect"] and {r.defect for r in found.select("defect").distinct().collect()} == set(p.DEFECTS)
