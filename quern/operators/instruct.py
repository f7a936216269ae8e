"""Instruction records: samples, labels, prompts, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import strip

# Ids of the special tokens and the label that is ignored.
PAD, UNK, BOS, EOS, IGNORE = 0, 1, 2, 3, -100


def sample_text(q: Column, a: Column) -> Column:
    return F.concat(F.lit("<user>"), q, F.lit("<end><assistant>"), a, F.lit("<end>"))


def marker_tokens(text: Column, legacy: bool = False) -> Column:
    """Markers as one token, else single characters; the legacy rule reads a marker's last sign once more."""
    if legacy:
        text = F.regexp_replace(text, "(<user>|<assistant>|<end>)", "$1>")
    return F.regexp_extract_all(text, F.lit(r"(<user>|<assistant>|<end>|(?s:.))"), F.lit(1))


def label_rule(prefix: Column, answer: Column) -> tuple[Column, Column]:
    """(input ids, labels): the prefix is ignored, the answer and the end are learned, shifted by one."""
    ids = F.concat(F.array(F.lit(BOS)), prefix, answer, F.array(F.lit(EOS)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(prefix)), answer, F.array(F.lit(EOS)), F.array(F.lit(IGNORE)))
    return ids, labels


def padded(a: Column, fill: int, n: int) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), n)), 1, n)


def evidence(a: Column, width: int = 60) -> tuple[Column, Column]:
    """Two slices of an answer; a short answer gives the first one twice."""
    one, two = F.substring(a, 1, width), F.substring(a, width + 1, width)
    return one, F.coalesce(F.nullif(two, F.lit("")), one)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body): lines before the first heading are dropped."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+\S")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("section", F.sum(head.cast("int")).over(w)).where("section > 0")
    out = marked.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform(F.slice(F.col("l"), F.lit(2), F.size("l")), lambda x: x["line"]), "\n")
    return out.select(key, "section", F.regexp_replace(F.col("l")[0]["line"], r"^#{1,6}\s+", "").alias("heading"), body.alias("body"))


def up_to_end(ids: Column) -> Column:
    """Ids before the first end mark, all where there is none."""
    at = F.array_position(ids, EOS)
    return F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(ids)


# Words that make a heading a guideline's, and the questions asked about headings.
GUIDELINE_WORDS = "诊断|治疗|预防|指南|规范|用药|管理|处理"
GUIDED, PLAIN = ("根据临床指南，%s的内容要点有哪些", "%s，具体应如何实施"), ("%s的临床诊疗要点是什么", "临床实践中，%s应如何处理")


def heading_questions(heading: Column) -> Column:
    """Two questions about a heading without its numbering; none for headings under 2 or over 40 characters."""
    h = F.trim(F.regexp_replace(heading, r"^[\d\s.．、-]+", ""))
    ask = lambda forms: F.array(*[F.format_string(f, h) for f in forms])
    asked = F.when(h.rlike(GUIDELINE_WORDS), ask(GUIDED)).otherwise(ask(PLAIN))
    return F.when(F.length(h).between(2, 40), asked).otherwise(F.array().cast("array<string>"))


def packed_segments(text: Column, least: int = 400, most: int = 900, block: int = 30) -> Column:
    """Paragraphs of some length appended to a segment while it stays under `most`; segments under `least` are dropped."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda b: F.length(b) >= block)
    empty = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    done = lambda acc: F.when(F.length(acc["now"]) >= least, F.concat(acc["out"], F.array(strip(acc["now"])))).otherwise(acc["out"])
    fits = lambda acc, b: F.length(acc["now"]) + F.length(b) < most
    step = lambda acc, b: F.struct(F.when(fits(acc, b), F.concat(acc["now"], b, F.lit("\n"))).otherwise(F.concat(b, F.lit("\n"))).alias("now"), F.when(fits(acc, b), acc["out"]).otherwise(done(acc)).alias("out"))
    return F.aggregate(blocks, empty, step, done)


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _tokens(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _frame(role: str) -> tuple[Column, Column]:
    head = F.concat(_tokens("<s>"), _tokens(*("system\n" + role)), _tokens("</s>", "\n", "<s>", *"user\n"))
    return head, _tokens("</s>", "\n", "<s>", *"assistant\n")


def chat_ids(question: Column, evidence: Column, role: str, limit: int) -> Column:
    """Tokens of a chat prompt within `limit`: the evidence is cut to what the frame and the question leave."""
    head, tail = _frame(role)
    before, after = _tokens(*"参考资料：\n"), _tokens("\n", "\n")
    room = F.lit(limit) - F.size(head) - F.size(_chars(question)) - F.size(tail) - F.size(before) - F.size(after)
    shown = F.concat(before, F.slice(_chars(evidence), F.lit(1), F.greatest(room, F.lit(0))), after)
    return F.concat(head, F.when((evidence != "") & (room > 0), shown).otherwise(F.array().cast("array<string>")), _chars(question), tail)


def preset_ids(question: Column, role: str, limit: int) -> Column:
    """Tokens of a prompt without evidence; beyond `limit` the last four stay and the rest is cut before them."""
    head, tail = _frame(role)
    whole = F.concat(head, _tokens(*"问题："), _chars(question), tail)
    return F.when(F.size(whole) > limit, F.concat(F.slice(whole, 1, limit - 4), F.slice(whole, -4, 4))).otherwise(whole)


def augmented_ids(evidence: Column, question: Column, limit: int) -> Column:
    """Evidence texts, a line end after each, up to limit - 16 tokens, then the question up to limit - 8, then the closing marks."""
    lines = F.flatten(F.transform(evidence, lambda e: F.concat(_chars(e), _tokens("\n"))))
    opened = F.slice(F.concat(_tokens("<bos>", "<user>"), lines), 1, limit - 16)
    return F.concat(F.slice(F.concat(opened, _chars(question)), 1, limit - 8), _tokens("<end>", "<assistant>"))
