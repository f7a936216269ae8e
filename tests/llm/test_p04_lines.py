import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from quern.llm import p04_lines as p

SCHEMA = "text_id long, source string, text string, files long, key string"


def brute(rows):
    files, holders, where = defaultdict(set), defaultdict(set), set()
    for key, source, text in rows:
        files[source].add(key)
        for n, line in enumerate((text or "").split("\n"), 1):
            k = "".join(c for c in unicodedata.normalize("NFKC", line).lower() if c.isalpha())
            if k:
                holders[source, k].add(key)
                where.add((key, n, source, k))
    return {(key, n) for key, n, s, k in where if len(holders[s, k]) >= 3 and len(holders[s, k]) * 5 >= len(files[s])}


def test_lines_against_brute_force(spark):
    rows = [(k, "a", f"Own text {chr(97 + k % 26) * 3} {chr(97 + k // 26) * 4}\nCopy right  {k}!\n\n12\nShared line") for k in range(60)]
    rows += [(100 + k, "b", f"Other {chr(97 + k % 26) * 5}{chr(97 + k // 26)}\nShared line\n" + ("ｃｏｏｋｉｅｓ" if k % 4 == 0 else "Cookies 3") * (k < 40) + "\nCookies") for k in range(60)]
    rows += [(300, "a", None), (301, "a", ""), (302, None, "Copy right"), (5, "a", rows[5][2]), (303, "b", "x\n" * 30000)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).select("text_id", F.coalesce("source", F.lit("\u0001")).alias("source"), "text")
    got = {tuple(r) for r in p.marked_lines(df).collect()}
    assert got == brute([r for r in rows])
    clean = {r.text_id: r.text for r in p.without_site_lines(df).collect()}
    assert clean[0] == "Own text aaa aaaa\n\n12" and clean[300] is None and clean[301] == "" and clean[302] == "Copy right" and len(clean) == 124
    assert p.marked_lines(df.limit(0)).count() == 0 and p.without_site_lines(df.limit(0)).count() == 0


def test_one_source_alone(spark):
    rows = [(k, "a", f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2}\nfooter") for k in range(40)]
    df = spark.createDataFrame(rows, "text_id long, source string, text string")
    assert {tuple(r) for r in p.marked_lines(df).collect()} == {(k, 2) for k in range(40)}


def test_tables(spark, data):
    rows = [tuple(r) for r in p._pages(spark, data).collect()]
    assert {tuple(r) for r in p.p4_found(spark, data).collect()} == brute(rows)
