"""Record filters and readers of loosely structured text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import FRONT_MATTER, HAN, han_count, strip

# Residue of tool calls in answers, and answers that found nothing.
TOOL_RESIDUE = (
    "<tool_call>", "<arg_key>", "<arg_value>", "doc_id",
    "我需要读取", "让我先读取", "让我读取", "让我先搜索", "让我进行搜索",
    "让我查看", "让我查一下", "正在读取文档", "为了回答该问题，我需要",
    "为了回答这个问题，我需要", "为了获取相关文档",
)
NEGATIVE_ANSWERS = (
    "我没有找到", "无法找到", "未找到任何", "没有找到与",
    "没有提及", "不包含任何", "没有包含", "不存在相关",
    "无法回答", "无法提供", "没有检索到", "未检索到",
    "我没有检索到", "没有在文档中", "未在文档中",
)
# Headings of a book's furniture and headings of a clinical topic.
NOISE_HEADING = (
    r"(?i)(电子书|PDF|代找|QQ|微信|购书|出版社|版权|版权所有|侵权|CIP|在版编目|"
    r"定价|新华书店|印刷|联系电话|联系|邮箱|热线|说明|目录|封面|前言|序言|"
    r"保留部分版权|许可协议|知识产权|组织西太平洋|图书在版|引言|序\s*$|"
    r"ZYYXH|ISO|GB\s*[0-9]|中华中医药学会|中国中医药出版社|WHO|ISBN)"
)
TOPIC_HEADING = (
    r"(诊断|治疗|预防|用药|管理|规范|指南|护理|康复|预后|症状|综合征|病|炎|"
    r"癌|瘤|感染|损伤|评估|筛查|标准|原则|适应证|禁忌|随访|监测|分期|分级|"
    r"急救|中毒|出血|休克|发热|疼痛|方案|流程|操作|检查|检验|影像|病理|"
    r"变性|肝豆状核|视网膜色素变性|黄斑变性)"
)
# Chapter titles, and labels by the tier of the path.
CHAPTER = r"^第[一二三四五六七八九十百0-9]+章"
TIER_LABELS = {"L1_": "卫健委规范", "L2_": "行业标准", "L3_": "学会指南", "L4_": "诊疗规范"}
DEFAULT_LABEL = "临床指南"


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def tool_residue(answer: Column) -> Column:
    return _any_of(answer, TOOL_RESIDUE)


def negative_answer(answer: Column) -> Column:
    return _any_of(answer, NEGATIVE_ANSWERS)


def listing_only(answer: Column) -> Column:
    """A list of found documents and hardly any sentence."""
    body = F.when(F.contains(answer, F.lit(":")), F.regexp_replace(answer, r"(?s)\A[^:]*:", "")).otherwise(answer)
    return F.startswith(answer, F.lit("找到")) & F.contains(answer, F.lit("结果")) & (F.length(body) > 20) & (han_count(body) / F.greatest(F.length(body), F.lit(1)) < 0.2)


def usable_log(instruction: Column, response: Column) -> Column:
    bounds = (F.length(instruction) >= 5) & F.length(response).between(30, 3000)
    return bounds & ~listing_only(response) & instruction.rlike(HAN) & response.rlike(HAN)


def search_log(df: DataFrame, content: str) -> DataFrame:
    """Adds instruction and response: the sections under their headings, stripped; empty where a section is missing."""
    body = F.regexp_replace(content, FRONT_MATTER, "")
    return df.withColumn("instruction", strip(F.regexp_extract(body, r"(?s)# Instruction\n(.*?)(?=\n# |\z)", 1))).withColumn("response", strip(F.regexp_extract(body, r"(?s)# Response\n+(.*)\z", 1)))


def is_contents(question: Column, answer: Column) -> Column:
    lines = F.filter(F.split(answer, "\n"), lambda s: s.rlike(CHAPTER + r"[^\n]*\.\.\.[^\n]*?[0-9]+$"))
    return question.rlike(CHAPTER) & (F.size(lines) >= 2)


def noise_heading(heading: Column) -> Column:
    return heading.rlike(NOISE_HEADING)


def topic_heading(heading: Column) -> Column:
    return heading.rlike(TOPIC_HEADING)


def document_label(path: Column, text: Column) -> Column:
    """The tier named in the path, else the tags or the type of the front matter, else the default."""
    matter = F.regexp_extract(text, r"\A---\n((?s:.*?))\n---", 1)
    out = F.lit(None).cast("string")
    for tier, label in reversed(TIER_LABELS.items()):
        out = F.when(F.contains(path, F.lit(tier)), F.lit(label)).otherwise(out)
    tags = F.when(matter.rlike(r"tags:\s*\[[^\]]*\]"), F.substring(F.trim(F.regexp_extract(matter, r"tags:\s*\[([^\]]*)\]", 1)), 1, 20))
    kind = F.when(matter.rlike(r"type:\s*\S"), F.regexp_extract(matter, r"type:\s*(\S+)", 1))
    return F.coalesce(out, tags, kind, F.lit(DEFAULT_LABEL))


def parse_pairs(text: Column) -> Column:
    """Question and answer pairs of a JSON array in a reply: in a fence, as the whole, or between the outermost brackets; both must be given."""
    kind = "array<struct<question:string,answer:string>>"
    t = strip(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    rows = F.coalesce(F.from_json(F.when(fenced != "", fenced), kind), F.from_json(F.when(t.startswith("["), t), kind), F.from_json(F.when(inner != "", inner), kind), F.array().cast(kind))
    return F.filter(rows, lambda d: (d["question"] != "") & (d["answer"] != ""))
