"""Column expressions over text: cleaning steps, line predicates, counts. Thresholds and patterns are arguments."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns, in the syntax that Java and RE2 share.
HAN = r"[\x{4e00}-\x{9fff}]"
EDGE_WHITE = r"\A[\s\x{3000}\x{00a0}\x{feff}]+|[\s\x{3000}\x{00a0}\x{feff}]+\z"
FRONT_MATTER = r"\A---\n(?s:.*?)\n---\n"
OCR_IMAGE = r"!\[\]\(page=[^)]+\)"
MD_IMAGE = r"!\[[^\n]*?\]\([^)]+\)"
RULE_ANYWHERE = r"---+\n?"
TABLE_RULE = r"\|[\s\-:]+\|"
HTML_TAG = r"<[^>]+>"
MD_LINK = r"\[([^\]]*)\]\([^)]+\)"
RULE_LINE = r"(?md)^---+\s*$"
HEADING, BULLET, QUOTE = r"(?md)^#{1,6}\s+", r"(?md)^[\*\-\+]\s+", r"(?md)^>\s?"
LATEX_ARGUMENT, LATEX, INLINE_MATH = r"\\[a-zA-Z]+(\{[^}]*\})?", r"\\[a-zA-Z]+", r"\$[^$]*\$"
PIPES, WHITE = r"[|]{2,}", r"[\s\x{3000}\x{00a0}]+"
WINDOWS_PATH = r"^[A-Za-z]:[\\/]"
PICTOGRAPH = r"^[\x{1F300}-\x{1F9FF}]"
OCR_LOG = r"^(glm ocr|处理用时|正在提取|💾|📁|📄|📂|输出文件|开始处理)"
DOUBLE_RULE, DASH_RULE = r"^={10,}$", r"^[\-]{10,}$"
NUMBERS = r"^[\d\s\.\,\%]+$"
TRACEBACK = r"^(Traceback|File \")"
TIMESTAMP = r"^\d{4}[-/]\d{2}[-/]\d{2}\s*\d{2}:\d{2}"
PROCESSING = r"^(Processing|Process finished)"
NUMBER_RUN = r"^[\d\s.+\-]+$"
PUBLISHER = (
    r"(?i)^(出版社|出版发行|发行|主编|编著|编委会|责任编辑|封面设计|印刷|版次|印次|开本|印张|字数|书号|ISBN|国际标准书号|定价|邮编|邮政编码|地址|电话|传真|"
    r"网址|E-?mail|QQ|购书热线|热线|版社|有限公司印刷|各地新华书店|版权所有|侵权必究|图书在版编目|CIP|社长热线|邮箱|电子邮箱)[:：\s]"
)
CONTENTS_LEADER = r"^[^\n]{0,60}[.．·]{5,}\s*\d{1,4}\s*$"
BOOK_NUMBER = r"(?i)^isbn[\s:]+"
IMPRINT = r"(出版社|印刷有限公司|版权所有|侵权必究|图书在版编目|定价[:：]|ISBN|购书热线|新华书店)"
ENGLISH_LINE = r"^[A-Za-z][A-Za-z0-9\s\.,:'()\-/]{15,}$"
CONTENTS_TITLE = r"^[\x{4e00}-\x{9fff}]{0,2}目\s*录$"
CONTROL_LINE = r"^(\{|---|throughput|profile)"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def han_count(text: Column) -> Column:
    """Code points in the basic Han block; 0 for null."""
    return F.coalesce(count_matches(text, HAN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_WHITE, "")


def collapse_blank(text: Column) -> Column:
    """Three and more line ends to two, runs of blanks to one, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def kept_lines(text: Column, predicate) -> Column:
    """Stripped lines that are not empty and for which `predicate(line)` (drop) is false, joined again."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~predicate(s)), "\n")


def share(text: Column, pattern: str) -> Column:
    return count_matches(text, pattern) / F.greatest(F.length(text), F.lit(1))


def log_rules(s: Column) -> dict[str, Column]:
    """The line rules of the first cleaner by name; each is true for a line to drop."""
    slashes = count_matches(s, r"/") + count_matches(s, r"\\")
    return {
        "windows_path": s.rlike(WINDOWS_PATH),
        "pictograph": s.rlike(PICTOGRAPH),
        "ocr_log": s.rlike(OCR_LOG),
        "rule": s.rlike(DOUBLE_RULE) | s.rlike(DASH_RULE),
        "numbers": s.rlike(NUMBERS),
        "traceback": s.rlike(TRACEBACK),
        "timestamp": s.rlike(TIMESTAMP),
        "processing": s.rlike(PROCESSING),
        "digit_share": share(s, "[0-9]") > 0.35,
        "pipes": count_matches(s, "[|]") >= 3,
        "number_run": s.rlike(NUMBER_RUN) & (F.length(s) > 20),
        "slashes": (count_matches(s, r"\\") > 0) & (slashes >= 2),
    }


def guide_rules(s: Column) -> dict[str, Column]:
    """The line rules of the guideline cleaner by name."""
    return {
        "publisher": s.rlike(PUBLISHER),
        "contents_leader": s.rlike(CONTENTS_LEADER),
        "book_number": s.rlike(BOOK_NUMBER),
        "imprint": s.rlike(IMPRINT) & (F.length(s) < 60),
        "english": s.rlike(ENGLISH_LINE) & (han_count(s) == 0),
        "bare_numbers": s.rlike(NUMBERS) | s.rlike(DOUBLE_RULE) | s.rlike(DASH_RULE),
        "contents_title": s.rlike(CONTENTS_TITLE),
        "digits": share(s, "[0-9]") > 0.35,
        "table_row": count_matches(s, "[|]") >= 3,
    }


def is_log_or_table(s: Column) -> Column:
    return reduce(or_, log_rules(s).values())


def is_guide_noise(s: Column) -> Column:
    return reduce(or_, guide_rules(s).values())


def clean_markdown(text: Column) -> Column:
    t = text
    for pattern, to in ((FRONT_MATTER, ""), (OCR_IMAGE, ""), (MD_IMAGE, ""), (RULE_ANYWHERE, ""), (TABLE_RULE, ""), (HTML_TAG, ""), (MD_LINK, "$1"), (HEADING, ""), (BULLET, ""), (QUOTE, "")):
        t = F.regexp_replace(t, pattern, to)
    return collapse_blank(kept_lines(t, is_log_or_table))


def clean_guide(text: Column) -> Column:
    t = text
    for pattern, to in ((FRONT_MATTER, ""), (OCR_IMAGE, ""), (MD_IMAGE, ""), (RULE_LINE, ""), (TABLE_RULE, ""), (HTML_TAG, ""), (MD_LINK, "$1"), (HEADING, "## "), (BULLET, ""), (QUOTE, "")):
        t = F.regexp_replace(t, pattern, to)
    t = kept_lines(t, is_guide_noise)
    for pattern in (LATEX, INLINE_MATH):
        t = F.regexp_replace(t, pattern, " ")
    return collapse_blank(t)


def clean_text(text: Column) -> Column:
    t = text
    for pattern in (LATEX_ARGUMENT, INLINE_MATH, HTML_TAG, MD_IMAGE, PIPES, WHITE):
        t = F.regexp_replace(t, pattern, " ")
    return strip(t)


def without_thoughts(text: Column) -> Column:
    """Closed <think> spans removed; an unclosed one ends after 120 characters or at the end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think.*?</think>", ""), r"(?s)<think.{0,120}", "")


def up_to_last(text: Column, marker: str) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*" + marker + ")", 1)


def without_control_lines(text: Column) -> Column:
    """Lines of a device capture that report on the device are dropped."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(CONTROL_LINE)), "\n")
