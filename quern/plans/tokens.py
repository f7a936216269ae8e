"""Registered queries: byte symbols, byte-pair ids, further retrieval forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import bpe, instruct, search
from quern.plans import catalog as c
from quern.plans.catalog import query
from quern.session import sized_join


@query("byte_symbols", "SELECT b::INT AS byte, chr((CASE WHEN plain THEN b ELSE 255 + row_number() OVER (PARTITION BY plain ORDER BY b) END)::INT) AS symbol FROM (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS plain FROM range(256) t(b))")
def byte_symbols(spark, folder):
    """T8."""
    return spark.createDataFrame(list(enumerate(bpe.byte_symbols())), "byte int, symbol string")


@query("bpe_ids")
def bpe_ids(spark, folder):
    """Ids of whole texts by merges of lowest rank, an end id behind each; blank texts dropped. Tested against brute force."""
    ids = bpe.encoded_texts(c.docs(spark, folder), "doc_id", "text", end=50_000)
    return ids.select("doc_id", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("bpe_merges")
def bpe_merges(spark, folder):
    """The merges behind the vocabulary; tokens whose parts are missing are left out."""
    with open(bpe.VOCABULARY, "rb") as f:
        rows = bpe.merges(bpe.ranks_of(f.read()))
    return spark.createDataFrame(rows, "rank int, left int, right int")


@query("valid_starts", "SELECT doc_id, len(list_filter(range(0, 8), lambda j: octet_length(encode(substr(text, 1, j::INT))) = 7)) > 0 AS whole FROM documents WHERE octet_length(encode(text)) > 7")
def valid_starts(spark, folder):
    """T11, ST3: whether the first seven bytes of a text end between characters."""
    d = c.docs(spark, folder).where(F.octet_length("text") > 7)
    return d.select("doc_id", F.is_valid_utf8(F.expr("cast(substring(cast(text as binary), 1, 7) as string)")).alias("whole"))


@query("question_text", f"SELECT doc_id, coalesce(string_agg(v.token, '' ORDER BY i.pos), '') AS text FROM (SELECT * FROM {c._IDS} WHERE pos <= 50) i JOIN ({c._VOCAB}) v ON v.id = i.token WHERE i.token >= 4 GROUP BY doc_id")
def question_text(spark, folder):
    """Ids under 4 and unknown ones dropped, the rest joined; of the first 50 ids, as many as a question holds."""
    ids = c.encoded(spark, folder).select("doc_id", F.posexplode(F.slice("ids", 2, 50)).alias("p", "id")).where("id >= 4")
    back = ids.join(F.broadcast(c.vocabulary(spark, folder).select("token", "id")), "id")
    return back.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"]), "").alias("text"))


_RECENT = "SELECT query_id, pos, count(DISTINCT ch) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT query_id, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS ch FROM retrieval_query WHERE text <> '')"


@query("recent_tokens", _RECENT)
def recent_tokens(spark, folder):
    """Distinct tokens among the last ten."""
    q = c._q_table(spark, folder).where("text <> ''").select("query_id", F.posexplode(F.split("text", "")).alias("p", "ch"))
    w = Window.partitionBy("query_id").orderBy("p").rowsBetween(-9, Window.currentRow)
    return q.select("query_id", (F.col("p") + 1).cast("long").alias("pos"), F.size(F.collect_set("ch").over(w)).cast("long").alias("recent"))


# ---------------------------------------------------------------- the compact index

_MIXED = "substr(substr(question, 1, 15) || chr(1) || substr(answer, 1, 35), 1, 50)"
_R1 = f"(SELECT term, count(*) AS df, least(floor(64 * ln(1 + (SELECT count(DISTINCT id) FROM {c._KB}) / count(*))), 255)::INT AS idf FROM (SELECT DISTINCT id, unnest(string_split({_MIXED}, '')) AS term FROM {c._KB}) GROUP BY term)"


def _compact(spark, folder):
    """Entries and the postings of question and answer starts, every character counted once."""
    k = c.kb(spark, folder)
    mixed = F.substring(F.concat(F.substring("question", 1, 15), F.lit("\x01"), F.substring("answer", 1, 35)), 1, 50)
    return k, search.postings(k, "id", F.split(mixed, ""))


@query("compact_index", f"SELECT term, df, idf FROM {_R1}")
def compact_index(spark, folder):
    """Weights of the characters of question and answer starts."""
    k, post = _compact(spark, folder)
    return search.idf(post, k.count())


_R2 = f"(SELECT query_id, doc_id, sum(idf)::BIGINT AS score FROM (SELECT DISTINCT query_id, unnest(string_split(text, '')) AS term FROM retrieval_query WHERE text <> '') q JOIN (SELECT id AS doc_id, unnest(string_split(substr(answer, 1, 50), '')) AS term FROM {c._KB}) d USING (term) JOIN {_R1} USING (term) GROUP BY query_id, doc_id)"
_R2_TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {_R2}) WHERE rank <= 3)"


@query("compact_top3", f"SELECT query_id, doc_id, score, rank FROM {_R2_TOP}")
def compact_top3(spark, folder):
    """Every occurrence in an answer's start counts, weighted by the other text's index; the lowest id wins ties."""
    k, post = _compact(spark, folder)
    wanted = search.by_term(c._q_table(spark, folder).where("text <> ''"), F.split("text", ""))
    weights = search.idf(sized_join(post, wanted.select("term"), ["term"], "left_semi"), k.count()).select("term", "idf")
    shown = search.postings(k, "id", F.split(F.substring("answer", 1, 50), ""), distinct=False)
    scored = sized_join(shown, sized_join(wanted, weights, ["term"]), ["term"]).select("doc_id", "idf", F.explode("queries").alias("query_id"))
    return search.best(scored.groupBy("query_id", "doc_id").agg(F.sum("idf").alias("score")), 3)


@query("joined_evidence", f"SELECT query_id, substr(string_agg(e, chr(10) ORDER BY rank), 1, 60) AS evidence FROM (SELECT t.query_id, t.rank, substr(k.answer, 1, 40) AS e FROM ({c._retrieve_sql(2)}) t JOIN (SELECT DISTINCT id, answer FROM {c._KB}) k ON k.id = t.doc_id) GROUP BY query_id")
def joined_evidence(spark, folder):
    """The texts of the best two documents, one a line, within a bound."""
    e = c.evidence_fetch(spark, folder).where("rank <= 2")
    lines = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence"))).alias("l"))
    return lines.select("query_id", F.substring(F.array_join(F.transform("l", lambda x: x["evidence"]), "\n"), 1, 60).alias("evidence"))


@query("retrieval_report", f"SELECT query_id, max(score) AS top1, min(score) AS top3, round(max(score)::DOUBLE / greatest(min(score), 1), 6) AS ratio, round(any_value(known)::DOUBLE / any_value(terms), 6) AS coverage FROM ({c._retrieve_sql(3)}) JOIN ({c.ORACLES['query_coverage']}) USING (query_id) GROUP BY query_id")
def retrieval_report(spark, folder):
    """Best and third score, their ratio, share of known characters."""
    top = c.retrieve_top3(spark, folder).groupBy("query_id").agg(F.max("score").alias("top1"), F.min("score").alias("top3"))
    seen = c.query_coverage(spark, folder)
    return top.join(seen, "query_id").select("query_id", "top1", "top3", F.round(F.col("top1") / F.greatest("top3", F.lit(1)), 6).alias("ratio"), F.round(F.col("known") / F.col("terms"), 6).alias("coverage"))


@query("tiered_top2", f"SELECT query_id, doc_id, CASE WHEN deep THEN 'full' ELSE 'compact' END AS tier FROM (SELECT r.query_id, r.doc_id, true AS deep FROM ({c._retrieve_sql(2)}) r WHERE r.query_id % 2 = 0 UNION ALL SELECT query_id, doc_id, false FROM {_R2_TOP} WHERE rank <= 2 AND (query_id % 2 = 1 OR query_id NOT IN (SELECT query_id FROM ({c._retrieve_sql(2)}))))")
def tiered_top2(spark, folder):
    """The full index where it was asked for and finds something, else the compact one."""
    full = c.retrieve_top3(spark, folder).where((F.col("rank") <= 2) & (F.col("query_id") % 2 == 0)).select("query_id", "doc_id", F.lit("full").alias("tier"))
    rest = compact_top3(spark, folder).where("rank <= 2").join(full.select("query_id").distinct(), "query_id", "left_anti")
    return full.unionByName(rest.select("query_id", "doc_id", F.lit("compact").alias("tier")))
