"""Registered queries: collection of cleaned texts, record filters, builders of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import filters, instruct, order
from quern.plans import catalog as c
from quern.plans.catalog import query
from quern.sources.tables import table

_HAN = "len(regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
_CLEAN_DOCS = c.ORACLES["clean_markdown"].replace("SELECT doc_id,", "SELECT doc_id, source, text,")


@query(
    "collect_clean",
    f"""SELECT source, count(*) AS files, count(*) FILTER (WHERE text IS NULL OR length(text) < 500) AS short,
    count(*) FILTER (WHERE length(text) >= 500 AND {_HAN.format(t='cleaned')} < 200) AS thin, count(*) FILTER (WHERE length(text) >= 500 AND {_HAN.format(t='cleaned')} >= 200) AS kept,
    coalesce(sum(length(cleaned)) FILTER (WHERE length(text) >= 500 AND {_HAN.format(t='cleaned')} >= 200), 0)::BIGINT AS chars
    FROM (SELECT source, text, cleaned FROM ({_CLEAN_DOCS}) UNION ALL SELECT source, text, NULL FROM documents WHERE text IS NULL) GROUP BY source""",
)
def collect_clean(spark, folder):
    """Short texts dropped, the rest cleaned, thin ones dropped; counters by source in one pass."""
    d = c.docs(spark, folder).select("source", F.coalesce(F.length("text"), F.lit(0)).alias("n"), T.clean_markdown(F.col("text")).alias("t"))
    short, han = F.col("n") < 500, T.han_count(F.col("t"))
    marked = d.select("source", short.alias("short"), (~short & (han < 200)).alias("thin"), F.length("t").alias("m"))
    kept = ~F.col("short") & ~F.col("thin")
    return marked.groupBy("source").agg(F.count("*").alias("files"), F.count_if("short").alias("short"), F.count_if("thin").alias("thin"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.col("m"))), F.lit(0)).cast("long").alias("chars"))


@query("nonblank", r"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '[^\s\x{3000}\x{00a0}\x{feff}]') GROUP BY source")
def nonblank(spark, folder):
    """texts with more than white space."""
    return c.docs(spark, folder).where(T.strip(F.col("text")) != "").groupBy("source").agg(F.count("*").alias("n"))


_PAIRS = "(SELECT DISTINCT id, coalesce(question, '') AS question, coalesce(answer, '') AS answer FROM format_data)"


def pairs(spark, folder):
    f = table(spark, folder, "format_data", ["id", "question", "answer"]).dropDuplicates(["id"])
    return f.select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


@query("thoughts_removed", f"SELECT id, CASE id % 3 WHEN 0 THEN answer WHEN 1 THEN substr('<think>' || answer, 127) ELSE answer END AS text FROM {_PAIRS} WHERE NOT contains(question, '<think') AND NOT contains(answer, '<think')")
def thoughts_removed(spark, folder):
    """Closed spans go, an open one goes with the 120 characters after its mark."""
    p = pairs(spark, folder).where(~F.contains("question", F.lit("<think")) & ~F.contains("answer", F.lit("<think")))
    q, a = F.col("question"), F.col("answer")
    marked = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<think>"), q, F.lit("</think>"), a)).when(F.col("id") % 3 == 1, F.concat(F.lit("<think>"), a)).otherwise(a)
    return p.select("id", T.without_thoughts(marked).alias("text"))


@query("whole_documents", f"SELECT id, question || '<|endoftext|>' AS text FROM {_PAIRS}")
def whole_documents(spark, folder):
    """A text is cut after the last end mark."""
    joined = F.concat("question", F.lit("<|endoftext|>"), F.substring("answer", 1, 30))
    return pairs(spark, folder).select("id", T.up_to_last(joined, r"<\|endoftext\|>").alias("text"))


@query("control_lines", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT (starts_with(s, '{') OR starts_with(s, '---') OR starts_with(s, 'throughput') OR starts_with(s, 'profile'))), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def control_lines(spark, folder):
    """Lines of a capture about the device itself."""
    return c.docs(spark, folder).where("text is not null").select("doc_id", T.without_control_lines(F.col("text")).alias("text"))


_LOG_PAIRS = f"(SELECT id, {c._strip('question')} AS q, {c._strip('answer')} AS a FROM {_PAIRS} WHERE NOT contains(question, chr(10) || '# ') AND NOT contains(answer, '# Response') AND {c._strip('question')} <> '' AND {c._strip('answer')} <> '')"


def search_log_pairs(spark, folder):
    """Knowledge-base pairs laid out as search logs and read back."""
    p = pairs(spark, folder).where(~F.contains("question", F.lit("\n# ")) & ~F.contains("answer", F.lit("# Response")))
    laid = p.select("id", F.concat(F.lit("---\nid: x\n---\n# Instruction\n\n"), "question", F.lit("\n\n# Response\n"), "answer").alias("content"))
    return filters.search_log(laid, "content").where("instruction <> '' and response <> ''")


@query("search_logs", f"SELECT id, q AS instruction, a AS response FROM {_LOG_PAIRS}")
def search_logs(spark, folder):
    """The two sections of a log, front matter dropped."""
    return search_log_pairs(spark, folder).select("id", "instruction", "response")


_TOOL = "regexp_matches(a, '<tool_call>|<arg_key>|<arg_value>|doc_id|我需要读取|让我先读取|让我读取|让我先搜索|让我进行搜索|让我查看|让我查一下|正在读取文档|为了回答该问题，我需要|为了回答这个问题，我需要|为了获取相关文档')"
_NEGATIVE = "regexp_matches(a, '我没有找到|无法找到|未找到任何|没有找到与|没有提及|不包含任何|没有包含|不存在相关|无法回答|无法提供|没有检索到|未检索到|我没有检索到|没有在文档中|未在文档中')"
_LIST_BODY = "(CASE WHEN contains(a, ':') THEN substr(a, strpos(a, ':') + 1) ELSE a END)"
_LIST_ONLY = f"(starts_with(a, '找到') AND contains(a, '结果') AND length({_LIST_BODY}) > 20 AND {_HAN.format(t=_LIST_BODY)}::DOUBLE / length({_LIST_BODY}) < 0.2)"
_USABLE = f"length(q) >= 5 AND length(a) BETWEEN 30 AND 3000 AND NOT {_LIST_ONLY} AND {_HAN.format(t='q')} > 0 AND {_HAN.format(t='a')} > 0"


@query("search_log_filter", f"SELECT count(*) AS pairs, count(*) FILTER (WHERE {_LIST_ONLY}) AS list_only, count(*) FILTER (WHERE {_USABLE} AND {_TOOL}) AS tool, count(*) FILTER (WHERE {_USABLE} AND NOT {_TOOL} AND {_NEGATIVE}) AS negative, count(*) FILTER (WHERE {_USABLE} AND NOT {_TOOL} AND NOT {_NEGATIVE}) AS kept FROM {_LOG_PAIRS}")
def search_log_filter(spark, folder):
    """Bounds, listings, residue of tools and refusals, with the counters."""
    p = search_log_pairs(spark, folder)
    usable, tool, negative = filters.usable_log(F.col("instruction"), F.col("response")), filters.tool_residue(F.col("response")), filters.negative_answer(F.col("response"))
    return p.agg(
        F.count("*").alias("pairs"), F.count_if(filters.listing_only(F.col("response"))).alias("list_only"), F.count_if(usable & tool).alias("tool"), F.count_if(usable & ~tool & negative).alias("negative"), F.count_if(usable & ~tool & ~negative).alias("kept")
    )


_CHAPTER = "^第[一二三四五六七八九十百0-9]+章"


@query("contents_documents", f"SELECT id, regexp_matches(question, '{_CHAPTER}') AND len(list_filter(string_split(answer, chr(10)), lambda s: regexp_matches(s, '{_CHAPTER}.*\\.\\.\\..*?[0-9]+$'))) >= 2 AS contents FROM (SELECT id, CASE WHEN id % 4 = 0 THEN '第3章 ' || question ELSE question END AS question, CASE WHEN id % 8 = 0 THEN '第3章 a....12' || chr(10) || '第4章 b...... 30' || chr(10) || answer ELSE answer END AS answer FROM {_PAIRS})")
def contents_documents(spark, folder):
    """tables of contents taken for entries."""
    i = F.col("id")
    p = pairs(spark, folder).select("id", F.when(i % 4 == 0, F.concat(F.lit("第3章 "), "question")).otherwise(F.col("question")).alias("q"), F.when(i % 8 == 0, F.concat(F.lit("第3章 a....12\n第4章 b...... 30\n"), "answer")).otherwise(F.col("answer")).alias("a"))
    return p.select("id", filters.is_contents(F.col("q"), F.col("a")).alias("contents"))


_HEADS = "SELECT DISTINCT doc_id, regexp_replace(l, '^#{1,6}\\s+', '') AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '^#{1,6}\\s+\\S')"
_NOISE_HEAD = "(?i)(电子书|PDF|代找|QQ|微信|购书|出版社|版权|版权所有|侵权|CIP|在版编目|定价|新华书店|印刷|联系电话|联系|邮箱|热线|说明|目录|封面|前言|序言|保留部分版权|许可协议|知识产权|组织西太平洋|图书在版|引言|序\\s*$|ZYYXH|ISO|GB\\s*[0-9]|中华中医药学会|中国中医药出版社|WHO|ISBN)"
_TOPIC_HEAD = "(诊断|治疗|预防|用药|管理|规范|指南|护理|康复|预后|症状|综合征|病|炎|癌|瘤|感染|损伤|评估|筛查|标准|原则|适应证|禁忌|随访|监测|分期|分级|急救|中毒|出血|休克|发热|疼痛|方案|流程|操作|检查|检验|影像|病理|变性|肝豆状核|视网膜色素变性|黄斑变性)"


@query("heading_filter", f"SELECT doc_id, head, regexp_matches(head, '{_NOISE_HEAD}') AS noise, regexp_matches(head, '{_TOPIC_HEAD}') AS topic FROM ({_HEADS})")
def heading_filter(spark, folder):
    """headings of a book's furniture, headings of a clinical topic."""
    l = c.docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"^#{1,6}\s+\S"))
    h = l.select("doc_id", F.regexp_replace("l", r"^#{1,6}\s+", "").alias("head")).distinct()
    return h.select("doc_id", "head", filters.noise_heading(F.col("head")).alias("noise"), filters.topic_heading(F.col("head")).alias("topic"))


_SECTIONS = c.ORACLES["heading_sections"].replace("FROM documents WHERE text IS NOT NULL", f"FROM (SELECT doc_id, cleaned AS text FROM ({c.ORACLES['clean_guide']}))")
_LABEL = "CASE WHEN regexp_matches(path, 'L1_') THEN '卫健委规范' WHEN regexp_matches(path, 'L2_') THEN '行业标准' WHEN regexp_matches(path, 'L3_') THEN '学会指南' WHEN regexp_matches(path, 'L4_') THEN '诊疗规范' WHEN regexp_matches(fm, 'tags:\\s*\\[[^\\]]*\\]') THEN substr(trim(regexp_extract(fm, 'tags:\\s*\\[([^\\]]*)\\]', 1)), 1, 20) WHEN regexp_matches(fm, 'type:\\s*\\S') THEN regexp_extract(fm, 'type:\\s*(\\S+)', 1) ELSE '临床指南' END"


@query("path_labels", f"SELECT doc_id, {_LABEL} AS label FROM (SELECT doc_id, coalesce(path, '') AS path, regexp_extract(coalesce(text, ''), '\\A---\\n((?s:.*?))\\n---', 1) AS fm FROM documents)")
def path_labels(spark, folder):
    """Label from the tier in the path, else from the front matter, else the default."""
    return c.docs(spark, folder).select("doc_id", filters.document_label(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("label"))


@query(
    "guide_entries",
    f"""SELECT doc_id, section, CASE WHEN regexp_matches(t, '诊断|治疗|预防|指南|规范|用药|管理|处理') THEN '根据临床指南，' || t || '的内容要点有哪些' ELSE t || '的临床诊疗要点是什么' END AS question, body AS answer,
    9999999 + row_number() OVER (ORDER BY doc_id, section) AS eid
    FROM (SELECT *, trim(regexp_replace(heading, '^[0-9\\s.．、-]+', '')) AS t FROM ({_SECTIONS}) WHERE length(body) BETWEEN 40 AND 1500 AND NOT regexp_matches(heading, '{_NOISE_HEAD}') AND regexp_matches(heading, '{_TOPIC_HEAD}')) WHERE length(t) BETWEEN 2 AND 40""",
)
def guide_entries(spark, folder):
    """Cleaned guides to sections, filtered headings and bodies, first question, running ids."""
    d = c.docs(spark, folder).where("text is not null").select("doc_id", T.clean_guide(F.col("text")).alias("text"))
    s = instruct.sections(d, "doc_id", "text").where(F.length("body").between(40, 1500) & ~filters.noise_heading(F.col("heading")) & filters.topic_heading(F.col("heading")))
    asked = s.select("doc_id", F.col("section").cast("long").alias("section"), F.try_element_at(instruct.heading_questions(F.col("heading")), F.lit(1)).alias("question"), F.col("body").alias("answer")).where("question is not null")
    ids = order.numbered(asked.select("doc_id", "section"), [F.col("doc_id"), F.col("section")]).select("doc_id", "section", (F.col("rn") + 9999999).alias("eid"))
    return asked.join(ids, ["doc_id", "section"])


_QA = "(SELECT DISTINCT qa_id, segment_idx, question, answer FROM deepseek_qa)"


@query("generated_pairs", f"SELECT qa_id, question, answer FROM {_QA} WHERE question <> '' AND answer <> ''")
def generated_pairs(spark, folder):
    """Pairs read from a model's reply, fenced, bare or inside other text."""
    p = table(spark, folder, "deepseek_qa", ["qa_id", "question", "answer"]).dropDuplicates(["qa_id"])
    reply = F.to_json(F.array(F.struct("question", "answer")))
    kind = F.col("qa_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure: "), reply, F.lit(" done."))).otherwise(reply)
    parsed = p.select("qa_id", F.explode(filters.parse_pairs(text)).alias("d"))
    return parsed.select("qa_id", "d.question", "d.answer")


@query("segments")
def segments(spark, folder):
    """Paragraphs packed greedily into segments; a fold, so without a twin in SQL (tested against brute force)."""
    d = c.docs(spark, folder).where("text is not null").select("doc_id", F.posexplode(instruct.packed_segments(F.col("text"))).alias("pos", "segment"))
    return d.where(T.han_count(F.col("segment")) > 50)
