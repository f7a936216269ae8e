from quern.llm import p03_scans as p

SCHEMA = "text_id long, text string, line_no string, noise int"


def test_long_chains_and_lines():
    lines = [str(k) if k % 2 else "some text" for k in range(1, 400)] + ["7"] * 70 + ["401", "   Page" + " " * 80 + "402 "]
    kept = p.page_numbers([s.strip() for s in lines])
    assert kept == [k for k in range(399) if lines[k] != "some text"] + [469, 470]


def english(k, cut="-", wrong=False):
    word = "obsession" if not wrong else "obsessi0n"
    return f"Chapter {k} On winter\nThe nurse will record the change and explain the reason for the obser{cut}\nvation today. Every reader should note the source and the record\n{12 + k}\nHandbook of Winter\nof the observation, then keep a half-\nlife table. The reason is the observation record and the {word}.\n\n{13 + k}\nHandbook of Winter\nThe reason for the observation is the change.\n"


def test_page_numbers():
    lines = ["a b c", "- 12 -", "x", "第 13 页", "80。", "Page 14 of 20", "7.", "[15]", "xv"]
    assert p.page_numbers(lines) == [1, 3, 5, 7]
    assert p.page_numbers(["lix", "text here", "lx"]) == [0, 2] and p.page_numbers(["P.6"]) == [0] and p.page_numbers([]) == []


def test_found_and_repaired(spark):
    docs = [(k, english(k, "-" if k % 2 else "\xad", wrong=k == 7), "x", None) for k in range(40)]
    filler = [(1000 + k, "The obsession is a reason.\nhalf-life and half-life and half-life table", None, None) for k in range(40)]
    odd = [(500, None, None, None), (501, "", None, None), (502, " \n\n", None, None), (503, "word " * 40000, None, None), (3, docs[3][1], "later", None)]
    df = spark.createDataFrame(docs + filler + odd, SCHEMA)
    got = {}
    for r in p.scan_noise(df).collect():
        got.setdefault(r.text_id, set()).add((r.line_no, r.noise))
    assert all({(4, "page_no"), (9, "page_no"), (5, "header"), (10, "header"), (2, "hyphen")} <= got[k] for k in range(40))
    assert all((6, "hyphen") not in got[k] and (1, "header") not in got[k] for k in range(40))
    assert not {500, 501, 502, 503} & set(got)
    fixed = {r.text_id: r.text for r in p.repair_scans(df).collect()}
    assert "observation today. Every reader should note the source and the record of the observation" in fixed[1] and "Handbook" not in fixed[1]
    assert fixed[500] is None and fixed[501] == "" and len(fixed[503]) >= 40000 * 5 - 1
    assert p.scan_noise(df.limit(0)).count() == 0


def test_misread_letters_and_signs(spark):
    good = ["section motion nation station ration lotion potion notion action option"] * 30
    bad = ["sectlon", "motlon", "natlon", "statlon", "ratlon", "lotlon"] * 4
    zh = ["患者今天出现头痛，同时伴有发热，随后时间逐渐延长，按时服药后好转，同时复查，有时反复，时好时坏。"] * 60
    zh_bad = ["患者今天出现头痛，同吋伴有发热，随后吋间逐渐延长，按吋服药后好转，同时复查，有吋反复，时好时坏。"] * 4
    rows = [(k, t, None, None) for k, t in enumerate(good + bad + zh + zh_bad)]
    found = {(r.text_id, r.noise) for r in p.scan_noise(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(good)
    assert {(n + k, "char") for k in range(len(bad))} <= found and not any(i < n for i, _ in found)
    m = n + len(bad)
    assert {(m + len(zh) + k, "char") for k in range(4)} <= found and not any(m <= i < m + len(zh) for i, _ in found)


def test_tables(spark, data):
    found = p.p3_found(spark, data)
    assert found.columns == ["text_id", "line_no", "noise"] and found.count() == found.distinct().count() > 0
