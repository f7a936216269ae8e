"""Readers of text, JSON and JSON lines, and writers of corpora, token sets and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import filters, order

TEXT_KEYS = ("text", "content", "answer", "instruction")


def first_given(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.md", skip: str = r"_index|_ocr") -> DataFrame:
    """(path, length, text) of the text files under a folder; names that match `skip` are left out. Bytes that are no UTF-8 become replacement signs."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return raw.where(~F.element_at(F.split("path", "/"), -1).rlike(skip)).select("path", "length", F.decode("content", "UTF-8").alias("text"))


def read_text_lines(spark: SparkSession, path: str, keys: tuple[str, ...] = TEXT_KEYS, skip: str = "test|valid") -> DataFrame:
    """(text): one a line of JSON lines: the first given of `keys`, or the line itself where it is a bare JSON string; blank and malformed lines and files of test sets are left out."""
    lines = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(path).where(~F.element_at(F.split(F.input_file_name(), "/"), -1).rlike(skip))
    line = F.trim("value")
    held = F.from_json(F.when(line.startswith("{"), line), "struct<" + ",".join(f"{k}:string" for k in keys) + ">")
    bare = F.get_json_object(F.concat(F.lit('{"v":'), F.when(line.startswith('"'), line), F.lit("}")), "$.v")
    return lines.select(F.coalesce(first_given(*[held[k] for k in keys]), F.nullif(bare, F.lit(""))).alias("text")).where("text is not null")


def read_pairs(spark: SparkSession, path: str, least_question: int = 5, least_answer: int = 30) -> DataFrame:
    """(question, answer) of instruction lines: the answer is the first given of output, answer and text; short pairs are left out."""
    raw = spark.read.schema("instruction string, question string, output string, answer string, text string").option("mode", "DROPMALFORMED").json(path)
    p = raw.select(first_given(F.col("instruction"), F.col("question")).alias("question"), first_given(F.col("output"), F.col("answer"), F.col("text")).alias("answer"))
    return p.where((F.length("question") >= least_question) & (F.length("answer") >= least_answer))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer): of each conversation of a JSON array the first human and the first assistant part; list values are joined by line ends."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    rows = raw.select(F.explode(F.from_json("value", "array<struct<conversations:array<struct<`from`:string,value:string>>>>")).alias("c"))
    # a list value arrives as its JSON text
    said = lambda x: F.when(x["value"].startswith("["), F.array_join(F.from_json(x["value"], "array<string>"), "\n")).otherwise(x["value"])
    first = lambda *who: F.try_element_at(F.transform(F.filter("c.conversations", lambda x: x["from"].isin(*who)), said), F.lit(1))
    return rows.select(first("human").alias("question"), first("gpt", "assistant").alias("answer"))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """(messages): of a JSON file with a `data` list, or a bare list, of chats."""
    chat = "struct<messages:array<struct<role:string,content:string>>>"
    raw = spark.read.format("text").option("wholetext", True).load(path)
    held = F.coalesce(F.from_json(F.when(F.trim("value").startswith("{"), F.col("value")), f"struct<data:array<{chat}>>")["data"], F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), f"array<{chat}>"))
    return raw.select(F.explode(held).alias("chat")).select("chat.messages")


def read_search_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(source, instruction, response) of the search logs of a folder; logs without one of the sections are left out."""
    logs = read_documents(spark, folder, "srch_*.md", skip=r"^$")
    return filters.search_log(logs.withColumn("source", F.element_at(F.split("path", "/"), -1)), "text").where("instruction <> '' and response <> ''").select("source", "instruction", "response")


def read_entries(spark: SparkSession, path: str, fallback: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(id, question, answer, label) of a finished knowledge base; where it is missing or empty the fallback. Malformed lines fail."""
    try:
        found = spark.read.schema("id long, question string, answer string, label string").option("mode", "FAILFAST").json(path)
        empty = found.isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = True
    if empty and fallback is None:
        raise ValueError(f"no entries in {path}")
    rows = fallback if empty else found
    return rows.orderBy("id").limit(most) if most else rows


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records, one JSON object a file."""
    return spark.read.option("multiLine", True).json(pattern)


def read_speed_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, norag, rag): token arrays by question."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    return raw.select(F.explode(F.from_json("value", "map<string,struct<norag:array<int>,rag:array<int>>>")).alias("name", "p")).select("name", "p.norag", "p.rag")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq, pos) of a user dictionary, split at white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("term"), F.try_element_at(parts, F.lit(2)).alias("freq"), F.try_element_at(parts, F.lit(3)).alias("pos"))


def write_corpus(docs: DataFrame, key: str, text: str, path: str, budget: int) -> None:
    """Texts in key order up to a budget of characters, a blank line after each, as text files whose names keep the order."""
    kept = order.budget_cap(docs.select(key, text), key, text, budget)
    kept.repartitionByRange(key).sortWithinPartitions(key).select(F.concat(text, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_token_splits(ids: DataFrame, key: str, path: str, fraction: float) -> None:
    """Token arrays in key order as train and val folders, the tail held out."""
    split = order.tail_split(ids.select(key), [F.col(key)], fraction).select(key, "split")
    ids.join(split, key).repartitionByRange("split", key).sortWithinPartitions("split", key).write.mode("overwrite").partitionBy("split").parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("token", "id").coalesce(1).sortWithinPartitions("id").write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id long").json(path)


def write_samples(samples: DataFrame, key: str, path: str, held_out: int, seed: int = 42) -> None:
    """Samples as train and val JSON lines: the first of a seeded order are held out."""
    numbered = order.numbered(samples.select(key, order.hash_order(F.col(key), seed).alias("_h")), [F.col("_h"), F.col(key)]).select(key, F.when(F.col("rn") <= held_out, "val").otherwise("train").alias("split"))
    samples.join(numbered, key).write.mode("overwrite").partitionBy("split").json(path)


def append_new(rows: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key the JSON lines at `path` don't hold yet."""
    spark = rows.sparkSession
    try:
        seen = spark.read.schema(rows.schema).json(path).select(key).distinct()
        rows = rows.join(seen, key, "left_anti").select(*rows.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.dropDuplicates([key]).write.mode("append").json(path)
