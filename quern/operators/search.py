"""Inverted index and batched retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import sized_join


def chars(text: Column) -> Column:
    """Characters other than white space."""
    return F.filter(F.split(text, ""), lambda c: ~c.rlike(r"^[\s\x{3000}]*$"))


def words(text: Column, least: int = 2) -> Column:
    """Lower-case words of Latin letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= least)


def postings(docs: DataFrame, key: str, terms: Column, distinct: bool = True) -> DataFrame:
    """Long form (doc_id, term); with `distinct` a term counts once per document."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(terms) if distinct else terms).alias("term"))


def idf(post: DataFrame, n_docs: int, clip: int | None = 255) -> DataFrame:
    """floor(64 * ln(1 + N / df)), clipped to a byte, of postings that hold a term once per document."""
    value = F.floor(64 * F.log(1 + F.lit(n_docs) / F.col("df")))
    out = post.groupBy("term").agg(F.count("*").alias("df"))
    return out.select("term", "df", (F.least(value, F.lit(clip)) if clip else value).cast("int").alias("idf"))


def by_term(queries: DataFrame, terms: Column, distinct: bool = True) -> DataFrame:
    """(term, queries): for each term of a batch of queries the queries that hold it, once or as often as they do."""
    q = queries.select("query_id", F.explode(F.array_distinct(terms) if distinct else terms).alias("term"))
    return q.groupBy("term").agg(F.collect_list("query_id").alias("queries"))


def hits(post: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, term, query_id) of the postings whose term a query of `wanted(term, queries)` holds; broadcast only after a count."""
    return sized_join(post, wanted, ["term"]).select("doc_id", "term", F.explode("queries").alias("query_id"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """Top k documents of each query, ties by document id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(post: DataFrame, n_docs: int, queries: DataFrame, terms: Column, k: int, distinct: bool = True) -> DataFrame:
    """Top k documents of every query of `queries(query_id, ...)`: sum of idf over shared terms.

    Only postings of the batch's terms are counted and scored, so neither the index nor its
    weights are formed for other terms.
    """
    wanted = by_term(queries, terms, distinct)
    mine = sized_join(post, wanted.select("term"), ["term"], "left_semi")
    weighted = sized_join(wanted, idf(mine, n_docs).select("term", "idf"), ["term"])
    scored = sized_join(mine, weighted, ["term"]).select("doc_id", "idf", F.explode("queries").alias("query_id"))
    return best(scored.groupBy("query_id", "doc_id").agg(F.sum("idf").alias("score")), k)


#: Most terms of a dictionary that is sent to the executors.
MOST_TERMS = 2_000_000


def longest_matches(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, terms): forward longest matches, consuming, of the dictionary `terms(term)` in each text; null texts have none."""
    words = sorted(r[0] for r in terms.select("term").where("term <> ''").distinct().limit(MOST_TERMS + 1).collect())
    if len(words) > MOST_TERMS:
        raise ValueError("dictionary too large to be sent along")
    sent = df.sparkSession.sparkContext.broadcast(words)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in sent.value:
            machine.add_word(w, w)
        if sent.value:
            machine.make_automaton()
        for batch in batches:
            found = [[w for _, w in machine.iter_long(t)] if t and sent.value else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "terms"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, terms array<string>")
