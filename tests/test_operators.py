"""Operators without a twin in SQL, and small cases worked out by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import arrays, bpe, filters, instruct, order, search
from quern.plans import records


def one(spark, column, value=None, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


def test_cleaning_cases(spark):
    v = F.col("v")
    assert one(spark, F.regexp_replace(v, T.FRONT_MATTER, ""), "---\nt: x\n---\n# H") == "# H"
    assert one(spark, F.regexp_replace(v, T.FRONT_MATTER, ""), "a\n---\nt\n---\nb") == "a\n---\nt\n---\nb"
    rules = lambda s: spark.createDataFrame([(s,)], "v string").select(*[c.alias(n) for n, c in (T.log_rules(v) | T.guide_rules(v)).items()]).first().asDict()
    assert not rules("12abcd")["digit_share"] and rules("123abc")["digit_share"]
    assert not rules("a|b|c")["pipes"] and rules("a|b|c|d")["pipes"]
    hits = {"glm ocr done": "ocr_log", "📄 file": "ocr_log", "定价：30": "publisher", "ISBN 978": "book_number", "某出版社印": "imprint", "Only English words here": "english", "目 录": "contents_title", "12. 3,4%": "numbers", "-----------": "rule", "一 ....... 12": "contents_leader"}
    for line, rule in hits.items():
        assert rules(line)[rule], (line, rule)
    assert not rules("出版社" + "长" * 60)["imprint"] and not rules("Short english")["english"] and not rules("English and 中文 in one line")["english"]
    assert one(spark, T.clean_markdown(v), "[](u) x") == "x" and one(spark, T.clean_markdown(v), None) is None and one(spark, T.clean_markdown(v), "") == ""
    assert one(spark, T.without_thoughts(v), "a<think>bc") == "a" and one(spark, T.without_thoughts(v), "a<think>b</think>c") == "ac"
    assert one(spark, T.without_control_lines(v), "{x\nok\nthroughput 3\n---") == "ok"


def test_order_cases(spark):
    d = spark.createDataFrame([(1, "aaaaa", "x"), (2, None, "x"), (3, "bbbbb", "x"), (4, "", "x"), (5, "ccccc", "x"), (6, "d", "x")], "k long, t string, before string").drop("before")
    assert [len(r.t) for r in order.budget_cap(d, "k", "t", 12).orderBy("k").collect()] == [5, 5, 2]
    assert order.tail_split(spark.range(250), [F.col("id")], 0.01).where("split = 'val'").count() == 2


def test_retrieval_cases(spark):
    post = spark.createDataFrame([(d, t) for d in range(3) for t in ("a", f"x{d}")], "doc_id long, term string")
    weights = {r.term: r.idf for r in search.idf(post, 1000).collect()}
    assert weights["a"] == 255 and weights["x0"] == 255 and search.idf(post, 1000, None).where("term = 'a'").first().idf == 371 and int(64 * math.log(2)) == 44
    q = spark.createDataFrame([(1, "aa"), (2, "zz"), (3, None)], "query_id int, text string")
    once, twice = (search.retrieve(post, 3, q, F.split("text", ""), 3, distinct).where("query_id = 1 and doc_id = 0").first().score for distinct in (True, False))
    assert twice == 2 * once == 2 * int(64 * math.log(2))
    assert search.retrieve(post.limit(0), 0, q, F.split("text", ""), 3).count() == 0
    terms = spark.createDataFrame([("ab",), ("abc",), ("",), (None,)], "term string")
    rows = spark.createDataFrame([(1, "abcabxab"), (2, None), (3, "")], "k long, t string")
    assert {r.k: list(r.terms) for r in search.longest_matches(rows, "k", "t", terms).collect()} == {1: ["abc", "ab", "ab"], 2: [], 3: []}
    assert search.longest_matches(rows, "k", "t", terms.limit(0)).first().terms == []


def test_kernel_cases(spark):
    e = F.col("v")
    cell = lambda c, v: one(spark, c, v, "v array<double>")
    assert cell(arrays.quantize(e, 4, 4), [3.5, 10.5, 17.5, 49.0]) == [0, 2, 2, 7] and cell(arrays.quantize(e, 4, 4), [-17.5, 49.0]) == [-2, 7]
    assert [b & 255 for b in one(spark, arrays.pack_nibbles(F.col("v")), [-7, 7, 0], "v array<int>")] == [0xF1, 0x88]
    assert cell(arrays.top_k_kept(e, 2), [3.0, 2.0, 2.0, 1.0]) == [3.0, 2.0, 2.0]
    assert cell(arrays.penalised(e, F.array(F.lit(0), F.lit(1)), 2.0), [2.0, -2.0]) == [1.0, -1.0]
    assert abs(cell(arrays.cross_entropy(e, F.lit(0)), [0.0, 0.0]) - math.log(2)) < 1e-12
    assert cell(arrays.sampled(e, F.lit(0.5)), [0.2, 0.3, 0.5]) == 2 and cell(arrays.sampled(e, F.lit(0.49)), [0.2, 0.3, 0.5]) == 1 and cell(arrays.sampled(e, F.lit(1.5)), [0.2, 0.8]) == 1
    assert all(abs(one(spark, arrays.gelu(F.col("v")), x, "v double") - x * 0.5 * (1 + math.erf(x / 2**0.5))) < 1e-6 for x in (-3.0, -0.5, 0.0, 0.7, 2.0))
    long = [float(k % 97) for k in range(20_000)]
    assert abs(sum(cell(arrays.softmax(e), long)) - 1) < 1e-9 and len(cell(arrays.quantize(e, 32, 4), long)) == 20_000 and cell(arrays.softmax(e), []) == []
    halves = arrays.as_halves(spark.createDataFrame([(1, [0.1, 70000.0, -2.5]), (2, None), (3, [])], "k long, v array<double>"), "k", "v").orderBy("k").collect()
    assert halves[0].v == np.array([0.1, 70000.0, -2.5]).astype(np.float16).astype(float).tolist() and halves[2].v == []


def test_byte_pairs_against_brute_force(spark):
    rnd = random.Random(2)
    with open(bpe.VOCABULARY, "rb") as f:
        content = f.read()
    ranks = bpe.ranks_of(content)

    def plain(data):
        parts = [data[k : k + 1] for k in range(len(data))]
        while True:
            at = min(((ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks), default=None)
            if at is None:
                return [ranks[p] for p in parts]
            parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]

    texts = ["".join(rnd.choice("abc the 在患者，。 \n") for _ in range(n)) for n in (0, 1, 5, 80, 300)] + ["aaaaaaaaaaaa", "é̂😀"]
    for t in texts:
        assert bpe.encode(t.encode(), ranks) == plain(t.encode()) == bpe.encoder(content)(t.encode())
    assert bpe.encoder(content)(b"\xed\xa0\x80 x") == bpe.encode(b"\xed\xa0\x80 x", ranks)
    back = {r: t for t, r in ranks.items()}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, " ", "长文" * 5000])], "k long, t string")
    got = {r.k: r.ids for r in bpe.encoded_texts(docs, "k", "t", end=-1).collect()}
    assert set(got) == {k for k, t in enumerate(texts) if t.strip()} | {9}
    assert all(b"".join(back[i] for i in ids[:-1]).decode() == [*texts, None, " ", "长文" * 5000][k] and ids[-1] == -1 for k, ids in got.items())


def test_segments_against_brute_force(spark):
    rnd = random.Random(4)
    text = "\n\n".join("字" * rnd.randrange(5, 500) for _ in range(60))

    def packed(t):
        out, now = [], ""
        for b in (x.strip() for x in re.split(r"\n\s*\n", t)):
            if len(b) >= 30:
                if len(now) + len(b) < 900:
                    now += b + "\n"
                else:
                    out += [now.strip()] if len(now) >= 400 else []
                    now = b + "\n"
        return out + ([now.strip()] if len(now) >= 400 else [])

    assert one(spark, instruct.packed_segments(F.col("v")), text) == packed(text) and one(spark, instruct.packed_segments(F.col("v")), "") == []


def test_entities(spark):
    near = lambda s, w: one(spark, records.entity_before(F.col("v"), w), s)
    assert near("对于急性胰腺炎的诊断标准", "的诊断标准") is not None and near("急性胰腺炎诊断标准如下", "诊断标准") == "急性胰腺炎"
    assert near("诊断标准", "诊断标准") is None and near("患者，诊断标准", "诊断标准") is None and near("没有", "诊断标准") is None


def test_replies(spark):
    parse = lambda t: [tuple(x) for x in one(spark, filters.parse_pairs(F.col("v")), t)]
    pair = '[{"question": "q]", "answer": "a"}, {"question": "", "answer": "b"}]'
    assert parse(pair) == parse("```json\n" + pair + "\n```") == parse("x " + pair + " y") == [("q]", "a")] and parse("nothing") == [] and parse("[broken") == []


def test_label_rule(spark):
    row = spark.createDataFrame([([11, 12], [21])], "p array<int>, a array<int>").select(*[c.alias(n) for n, c in zip("il", instruct.label_rule(F.col("p"), F.col("a")))]).first()
    assert row.i == [2, 11, 12, 21, 3] and row.l == [-100, -100, 21, 3, -100]
    e1, e2 = (one(spark, c, "长" * 40) for c in instruct.evidence(F.col("v")))
    assert e1 == e2 == "长" * 40


def template_brute(texts):
    out = set()
    for text in texts:
        for s in re.split(r"[。！？\n]+", text or ""):
            s = s.strip(" \t\r\n　\xa0﻿")
            if not 20 <= len(s) <= 200:
                continue
            for aspect, words in records.ASPECTS.items():
                for w in words:
                    at = s.find(w)
                    ends = [s[:at][-n:].strip() for n in range(8, 1, -1)] if at > 0 else []
                    fit = [e for e in ends if len(e) >= 2 and not re.match(r"[\d\s.()（）【】\[\]一二三四五六七八九十]", e) and not re.search(r"[，。；：？！、（）()《》\"'【】]", e) and re.search(records.ENTITY_ENDS, e) and not re.search(records.NO_ENTITY, e) and not re.fullmatch(r"[\d\sA-Za-z]+", e)]
                    if fit:
                        out.add(f"{fit[0]}的{aspect}是什么？")
                        break
    return out


def test_template_questions_against_brute_force(spark, data, tmp_path):
    rnd = random.Random(6)
    parts = ["急性胰腺炎", "患者", "诊断标准", "治疗原则", "鉴别诊断", "骨折", "，", "糖尿病 ", "3", "症状", "随访", "。", "\n", "的", "处理后观察若干天再做安排"]
    texts = ["".join(rnd.choice(parts) for _ in range(60)) for _ in range(80)] + [None, "", "短"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    asked = [r.question for r in records.template_questions(spark, str(tmp_path)).collect()]
    assert set(asked) == template_brute(texts) and len(asked) == len(set(asked)) > 10
    whole = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    assert {r.question for r in records.template_questions(spark, data).collect()} == template_brute(whole)
