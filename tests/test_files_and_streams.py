import json
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import files
from quern.streaming import routed
from quern.streaming.tokens import Assembler, assembled


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# 标题\n正文", encoding="utf-8")
    (tmp_path / "a" / "x_ocr.md").write_text("no", encoding="utf-8")
    (tmp_path / "a" / "srch_1.md").write_text("---\nid: 1\n---\n# Instruction\n\n问题\n\n# Response\n回答\n第二行\n", encoding="utf-8")
    assert {r.path.rsplit("/", 1)[1] for r in files.read_documents(spark, str(tmp_path / "a")).collect()} == {"x.md", "srch_1.md"}
    assert [tuple(r) for r in files.read_search_logs(spark, str(tmp_path / "a")).collect()] == [("srch_1.md", "问题", "回答\n第二行")]
    lines = tmp_path / "l"
    lines.mkdir()
    (lines / "train.jsonl").write_text('{"content": "c", "text": " "}\n"bare \\"x\\""\n\n{broken\n{"instruction": "i", "answer": "a"}\n', encoding="utf-8")
    (lines / "test.jsonl").write_text('{"text": "held out"}\n')
    assert sorted(r.text for r in files.read_text_lines(spark, str(lines)).collect()) == ["a", 'bare "x"', "c"]
    (tmp_path / "p.jsonl").write_text(json.dumps({"instruction": "long question", "output": "", "answer": "x" * 30}) + "\nbroken\n" + json.dumps({"instruction": "q", "output": "y" * 40}) + "\n")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.jsonl")).collect()] == [("long question", "x" * 30)]
    (tmp_path / "c.json").write_text(json.dumps([{"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": ["a", "b"]}, {"from": "gpt", "value": "c"}, {"from": "human", "value": "d"}]}]))
    assert [tuple(r) for r in files.read_conversations(spark, str(tmp_path / "c.json")).collect()] == [("a\nb", "c")]
    chats = [{"messages": [{"role": "user", "content": "u"}]}]
    for k, held in enumerate((chats, {"data": chats})):
        (tmp_path / f"m{k}.json").write_text(json.dumps(held))
        assert files.read_chats(spark, str(tmp_path / f"m{k}.json")).first().messages[0].content == "u"
    (tmp_path / "d.txt").write_text("头痛 3 n\n\n发热\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("头痛", "3", "n"), ("发热", None, None)]
    (tmp_path / "s.json").write_text('{"q1": {"norag": [1], "rag": [1, 2]}}')
    assert tuple(files.read_speed_prompts(spark, str(tmp_path / "s.json")).first()) == ("q1", [1], [1, 2])
    (tmp_path / "run.json").write_text('{"arm": "x",\n"final_val": 1.5}')
    assert files.read_runs(spark, str(tmp_path / "run.json")).first().arm == "x"
    other = spark.createDataFrame([(2, "q", "a", None), (1, "q", "a", None)], "id long, question string, answer string, label string")
    assert files.read_entries(spark, str(tmp_path / "none.jsonl"), other, 1).first().id == 1
    with pytest.raises(ValueError):
        files.read_entries(spark, str(tmp_path / "none.jsonl"))


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)], "id long, t string")
    files.write_corpus(docs, "id", "t", str(tmp_path / "corpus"), 65)
    parts = sorted((tmp_path / "corpus").glob("part-*.txt"))
    assert "".join(p.read_text() for p in parts).split("\n\n")[:3] == ["text 0", "text 1", "text 2"]
    files.write_token_splits(docs.select("id", F.array(F.col("id").cast("int")).alias("ids")), "id", str(tmp_path / "tokens"), 0.1)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "tokens")).where("split = 'val'").collect()} == {27, 28, 29}
    files.write_vocabulary(spark.createDataFrame([("a", 4), ("\n", 5)], "token string, id long"), str(tmp_path / "v"))
    assert {tuple(r) for r in files.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {("a", 4), ("\n", 5)}
    files.write_samples(docs, "id", str(tmp_path / "sft"), 5)
    assert spark.read.json(str(tmp_path / "sft")).where("split = 'val'").count() == 5
    for _ in range(2):
        files.append_new(docs, "id", str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 30


def test_assembler_is_free_of_the_cutting():
    rnd = random.Random(1)
    text = "头<think>隐藏</think>尾😀<thin ok</think 末"
    for _ in range(50):
        data, machine, out = text.encode(), Assembler(), ""
        while data:
            n = rnd.randrange(1, 9)
            out += machine.feed(data[:n])
            data = data[n:]
        assert out + machine.close() == "头>尾😀<thin ok</think 末".replace(">", "", 1)
    lost = Assembler()
    assert "".join(lost.feed(b"a") for _ in range(3)) == "aaa" and lost.feed(b"<think>") == ""
    shown = [lost.feed(b"x") for _ in range(40)]
    assert "".join(shown) and "".join(shown) == "x" * len("".join(shown)) and len("".join(shown)) <= 11


def test_stream_of_tokens(spark, tmp_path):
    schema = "request long, pos long, token binary, last boolean"
    parts = [("你<thi".encode(), False), ("nk>x</think>好".encode()[:-1], False), ("好".encode()[-1:], False), (b" end", True)]
    rows = [(r, k, bytearray(t), last) for r in (1, 2) for k, (t, last) in enumerate(parts)]
    for k, chunk in enumerate((rows[:2], rows[2:5], rows[5:])):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    run = assembled(source).writeStream.format("memory").queryName("assembled_test").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("assembled_test").collect()
    for r in (1, 2):
        assert "".join(x.text for x in got if x.request == r) == "你>好 end".replace(">", "", 1) and sum(x.closed for x in got if x.request == r) == 1


def test_lines(spark):
    lines = ['{"ids": [1, 2], "max": 900}', "SHOOT", "KEY  up ", "\r\n", "RAGQ 感冒", "{broken", "hello", None]
    got = [(r.command, r.argument, r.ids, r.most) for r in routed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("prompt", "[1, 2], \"max\": 900}", [1, 2], 50), ("shoot", "", None, None), ("key", "up", None, None), ("query", "感冒", None, None), ("prompt", "", None, None), ("text", "", None, None)]
