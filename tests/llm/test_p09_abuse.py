import numpy as np
import pyarrow as pa

from quern.llm import p09_abuse as p


def test_disguises():
    assert p.sentences("You m1$erable i d*i.o t!! 3.5 mg") == ["youmiserableidiot"] or p.sentences("You m1$erable i d*i.o t!!")[0].startswith("youmiserable")
    assert p.sentences("你这个笨​*蛋，走开！") == ["你这个笨蛋走开"] and p.sentences(None) == [] and p.sentences("stuuupid fool x") == ["stupidfoolx"] and p.sentences("дууурак ты, 滚滚滚滚开吧") == ["дуракты滚开吧"]


def test_kernel_against_brute_force():
    marks, text = ["笨蛋走开吧", "abcdefgh"], "好笨大蛋走x开吧abxcdefg"

    def features(s):
        out = {}
        han = [c >= "⺀" for c in s]
        for sets, width, first in ((p.HAN_OFFSETS, 3, True), (p.OTHER_OFFSETS, 5, False)):
            for k in range(len(s)):
                if han[k] == first:
                    for o in sets:
                        if k + o[-1] < len(s):
                            key = (first, s[k], *(s[k + x] for x in o))
                            out[key] = out.get(key, 0) + p.DECAY ** (o[-1] - width + 1)
        return out

    kernel = p.Kernel(marks)
    at, k = kernel.values(["无关", text])
    f = [features(m) for m in marks]
    want = [sum(w * features(text).get(g, 0) for g, w in m.items()) / sum(w * w for w in m.values()) ** 0.5 for m in f]
    assert at.tolist() == [1] and np.allclose(k[0], want)


BAD = ["你这个笨蛋走开", "写文的蠢材走开", "你这个坏种消失", "写文的笨蛋消失"]


def corpus(n=400):
    words = "护士每天记录读数并在复诊时交给医生查看结果以便调整方案".encode().decode()
    docs = []
    for k in range(n):
        cut = k % 17
        docs.append((k, f"s{k % 3}", words[cut:] + "。" + words[:cut] + f"第{k}次。" + ("中间，" + BAD[k % 4] + "！" if k % 20 == 0 else ""), "clash"))
    return docs


def test_scores(spark):
    odd = [(900, "s1", None, "c"), (901, None, "", "c"), (902, "s1", "护士" * 60000, "c"), (0, "s0", corpus(1)[0][2], "c")]
    docs = spark.createDataFrame(corpus() + odd, "doc_id long, source string, text string, score string")
    reviews = spark.createDataFrame([(k, int(k % 20 == 0), "c") for k in range(200)] + [(None, 1, "c"), (5, None, "c")], "doc_id long, abusive int, source string")
    got = {r.doc_id: r.score for r in p.abuse_scores(docs, reviews).collect()}
    assert {k for k, v in got.items() if v > 0} == {k for k in range(0, 400, 20)} and got[900] == got[901] == p.EMPTY
    assert p.abuse_scores(docs, reviews.limit(0)).where("score > 0").count() == 0
    assert p.abuse_scores(docs.limit(0), reviews).count() == 0


def test_held_out_reviews(data):
    import duckdb

    folder = data.replace("sf0.001", "sf0.1")
    con = duckdb.connect()
    docs = dict(con.execute(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    labels = con.execute(f"select doc_id, abusive from '{folder}/review_label.parquet' order by hash(doc_id)").fetchall()
    counts = np.zeros((1 << p.TABLE_BITS) + 1, dtype=np.int64)
    p.fill_runs(pa.RecordBatch.from_arrays([pa.array(list(docs.values()))], ["text"]), counts)
    machine = p.train([(docs[i], bool(a)) for i, a in labels if i % 3], counts)
    flagged = {i: max([-1.0, *machine.scores(p.sentences(docs[i]))]) > 0 if p.sentences(docs[i]) else False for i, _ in labels if i % 3 == 0}
    bad = [flagged[i] for i, a in labels if i in flagged and a]
    good = [flagged[i] for i, a in labels if i in flagged and not a]
    print("held out: recall", np.mean(bad), "false alarms", np.mean(good))
    assert np.mean(bad) > 0.9 and np.mean(good) < 0.01
