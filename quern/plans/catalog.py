"""The registered queries of the core, each over whole tables, and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import arrays, instruct, order, search
from quern.session import sized_join
from quern.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for name in ("cleaning", "records", "tokens", "checks"):
        importlib.import_module(f"quern.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


# ---------------------------------------------------------------- SQL fragments


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


def _chain(text: str, steps) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(to)}, 'g')"
    return text


def _strip(text: str) -> str:
    return _chain(text, [(T.EDGE_WHITE, "")])


def _kept(text: str, drop: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10)), lambda s: {_strip('s')})"
    return f"array_to_string(list_filter({lines}, lambda s: s <> '' AND NOT ({drop})), chr(10))"


def _collapse(text: str) -> str:
    return _strip(f"regexp_replace({_chain(text, [(chr(92) + 'n{3,}', chr(10) * 2)])}, '[ \\t]{{2,}}', ' ', 'g')")


# Written by hand, apart from the patterns of the Spark side, so that one checks the other.
_LOG_SQL = {
    "windows_path": r"regexp_matches(s, '^[A-Za-z]:[\\/]')",
    "pictograph": "unicode(s[1]) BETWEEN 127744 AND 129535",
    "ocr_log": " OR ".join(f"starts_with(s, '{w}')" for w in "glm ocr,处理用时,正在提取,💾,📁,📄,📂,输出文件,开始处理".split(",")),
    "rule": "length(s) >= 10 AND (replace(s, '=', '') = '' OR replace(s, '-', '') = '')",
    "numbers": r"regexp_matches(s, '^[0-9\s.,%]+$')",
    "traceback": "starts_with(s, 'Traceback') OR starts_with(s, 'File \"')",
    "timestamp": r"regexp_matches(s, '^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\s*[0-9]{2}:[0-9]{2}')",
    "processing": "starts_with(s, 'Processing') OR starts_with(s, 'Process finished')",
    "digit_share": "len(regexp_extract_all(s, '[0-9]'))::DOUBLE / length(s) > 0.35",
    "pipes": "length(s) - length(replace(s, '|', '')) >= 3",
    "number_run": r"regexp_matches(s, '^[0-9\s.+-]+$') AND length(s) > 20",
    "slashes": "contains(s, chr(92)) AND 2 * length(s) - length(replace(s, '/', '')) - length(replace(s, chr(92), '')) >= 2",
}
_GUIDE_SQL = {
    "publisher": "regexp_matches(s, '(?i)^(出版社|出版发行|发行|主编|编著|编委会|责任编辑|封面设计|印刷|版次|印次|开本|印张|字数|书号|ISBN|国际标准书号|定价|邮编|邮政编码|地址|电话|传真|网址|E-?mail|QQ|购书热线|热线|版社|有限公司印刷|各地新华书店|版权所有|侵权必究|图书在版编目|CIP|社长热线|邮箱|电子邮箱)[:：\\s]')",
    "contents_leader": r"regexp_matches(s, '^.{0,60}[.．·]{5,}\s*[0-9]{1,4}\s*$')",
    "book_number": r"regexp_matches(lower(s), '^isbn[\s:]+')",
    "imprint": "length(s) < 60 AND regexp_matches(s, '出版社|印刷有限公司|版权所有|侵权必究|图书在版编目|定价[:：]|ISBN|购书热线|新华书店')",
    "english": r"regexp_matches(s, '^[A-Za-z][A-Za-z0-9\s.,:''()/-]{15,}$')",
    "bare_numbers": r"regexp_matches(s, '^[0-9\s.,%]+$') OR (length(s) >= 10 AND (replace(s, '=', '') = '' OR replace(s, '-', '') = ''))",
    "contents_title": r"regexp_matches(s, '^[\x{4e00}-\x{9fff}]{0,2}目\s*录$')",
    "digits": "len(regexp_extract_all(s, '[0-9]'))::DOUBLE / length(s) > 0.35",
    "table_row": "length(s) - length(replace(s, '|', '')) >= 3",
}
_LOG, _GUIDE = (" OR ".join(f"({rule})" for rule in rules.values()) for rules in (_LOG_SQL, _GUIDE_SQL))
_FRONT = r"\A---\n(?s:.*?)\n---\n"
_MARKDOWN = [(_FRONT, ""), (r"!\[\]\(page=[^)]+\)", ""), (r"!\[.*?\]\([^)]+\)", ""), (r"---+\n?", ""), (r"\|[\s:-]+\|", ""), ("<[^>]+>", ""), (r"\[([^\]]*)\]\([^)]+\)", "\\1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[*+-]\s+", ""), (r"(?m)^>\s?", "")]
_GUIDE_STEPS = [(_FRONT, ""), (r"!\[\]\(page=[^)]+\)", ""), (r"!\[.*?\]\([^)]+\)", ""), (r"(?m)^---+\s*$", ""), (r"\|[\s:-]+\|", ""), ("<[^>]+>", ""), (r"\[([^\]]*)\]\([^)]+\)", "\\1"), (r"(?m)^#{1,6}\s+", "## "), (r"(?m)^[*+-]\s+", ""), (r"(?m)^>\s?", "")]
_TEXT_STEPS = [(p, " ") for p in (T.LATEX_ARGUMENT, T.INLINE_MATH, T.HTML_TAG, T.MD_IMAGE, T.PIPES, T.WHITE)]
_KB = "(SELECT DISTINCT id, question, answer, label FROM format_data WHERE length(question) >= 3 AND length(answer) >= 20)"


def docs(spark, folder) -> DataFrame:
    return table(spark, folder, "documents")


def kb(spark, folder) -> DataFrame:
    """Usable knowledge-base entries; a key that comes again holds the same content and counts once."""
    f = table(spark, folder, "format_data", ["id", "question", "answer", "label"])
    return f.where((F.length("question") >= 3) & (F.length("answer") >= 20)).dropDuplicates(["id"])


# ---------------------------------------------------------------- scans, cleaning, filters


@query("scan_ranked", f"SELECT doc_id, path, {_n('text', T.HAN)}::BIGINT AS han FROM documents WHERE octet_length(encode(text)) >= 500 AND {_n('text', T.HAN)} >= 20 AND path NOT LIKE '%_ocr%'")
def scan_ranked(spark, folder):
    """Texts of some size with enough Han characters, ranked by their count."""
    d = docs(spark, folder).where((F.octet_length("text") >= 500) & ~F.col("path").contains("_ocr"))
    return d.select("doc_id", "path", T.han_count(F.col("text")).cast("long").alias("han")).where("han >= 20").orderBy(F.desc("han"), "doc_id")


@query("scan_counts", "SELECT source, count(*) AS files, count(*) FILTER (WHERE NOT regexp_matches(path, '_index|_ocr')) AS plain, coalesce(sum(length(text)), 0)::BIGINT AS chars, sum(CASE WHEN text IS NULL OR length(text) < 500 THEN 1 ELSE 0 END)::BIGINT AS short FROM documents GROUP BY source")
def scan_counts(spark, folder):
    """Counts by source."""
    return docs(spark, folder).groupBy("source").agg(F.count("*").alias("files"), F.count_if(~F.col("path").rlike("_index|_ocr")).alias("plain"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.sum((F.col("text").isNull() | (F.length("text") < 500)).cast("long")).alias("short"))


@query("clean_markdown", f"SELECT doc_id, {_collapse(_kept(_chain('text', _MARKDOWN), _LOG))} AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_markdown(spark, folder):
    """C2-C11, C15, with the line rules L1-L13."""
    return docs(spark, folder).where("text is not null").select("doc_id", T.clean_markdown(F.col("text")).alias("cleaned"))


@query("clean_guide", f"SELECT doc_id, {_collapse(_chain(_kept(_chain('text', _GUIDE_STEPS), _GUIDE), [(T.LATEX, ' '), (T.INLINE_MATH, ' ')]))} AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_guide(spark, folder):
    """C16, with the line rules L1, L10, L11, L15-L21."""
    return docs(spark, folder).where("text is not null").select("doc_id", T.clean_guide(F.col("text")).alias("cleaned"))


@query("clean_text", f"SELECT doc_id, {_strip(_chain('text', _TEXT_STEPS))} AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_text(spark, folder):
    """C12-C14, C17."""
    return docs(spark, folder).where("text is not null").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


_REASONS = ", ".join(f"count(*) FILTER (WHERE s <> '' AND ({rule}))::BIGINT AS {name}" for name, rule in (_LOG_SQL | _GUIDE_SQL).items())


@query("line_reasons", f"SELECT count(*)::BIGINT AS lines, count(*) FILTER (WHERE s = '')::BIGINT AS empty, {_REASONS} FROM (SELECT {_strip('l')} AS s FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL))")
def line_reasons(spark, folder):
    """One counter for each rule over all lines."""
    raw = docs(spark, folder).where("text is not null").select(F.explode(F.split("text", "\n")).alias("l"))
    lines = raw.select(T.strip(F.col("l")).alias("s"))
    some = F.col("s") != ""
    rules = T.log_rules(F.col("s")) | T.guide_rules(F.col("s"))
    return lines.agg(F.count("*").alias("lines"), F.count_if(~some).alias("empty"), *[F.count_if(some & rule).alias(name) for name, rule in rules.items()])


@query("pool_filters", "SELECT id, length(question) >= 5 AND length(answer) >= 30 AS sft, length(question) >= 3 AND length(answer) >= 20 AS kb, length(question) >= 3 AND length(answer) >= 30 AS raft, length(answer) BETWEEN 40 AND 1500 AS section FROM (SELECT DISTINCT id, coalesce(question, '') AS question, coalesce(answer, '') AS answer FROM format_data)")
def pool_filters(spark, folder):
    """S6, S8, S13, F1-F3 with null as the empty string."""
    f = table(spark, folder, "format_data", ["id", "question", "answer"]).select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()
    q, a = F.length("question"), F.length("answer")
    return f.select("id", ((q >= 5) & (a >= 30)).alias("sft"), ((q >= 3) & (a >= 20)).alias("kb"), ((q >= 3) & (a >= 30)).alias("raft"), a.between(40, 1500).alias("section"))


# Parts of labels outside medicine.
OTHER_LABELS = ("健康管理", "理赔", "产品条款", "销售", "消保")


@query("label_filter", "SELECT trim(lower(label)) AS label, count(*) AS n FROM (SELECT DISTINCT id, label FROM format_data) WHERE label IS NOT NULL AND NOT (contains(label, '健康管理') OR contains(label, '理赔') OR contains(label, '产品条款') OR contains(label, '销售') OR contains(label, '消保')) GROUP BY 1")
def label_filter(spark, folder):
    """Labels without a part from outside medicine."""
    f = table(spark, folder, "format_data", ["id", "label"]).distinct().where("label is not null").where(~F.col("label").rlike("|".join(OTHER_LABELS)))
    return f.groupBy(F.trim(F.lower("label")).alias("label")).agg(F.count("*").alias("n"))


@query("json_requests", "SELECT event_id, least((props::JSON ->> '$.k')::BIGINT, 50) AS k FROM events WHERE props IS NOT NULL")
def json_requests(spark, folder):
    """A bounded field of a JSON column; malformed rows give null."""
    return table(spark, folder, "events", ["event_id", "props"]).where("props is not null").select("event_id", F.least(F.from_json("props", "k BIGINT")["k"], F.lit(50).cast("long")).alias("k"))


# Parts by which a dictionary term is no medical one.
NOISE_PARTS = ("严防", "商业", "疫情监测", "自我监测", "人员", "原则", "病例", "法规", "报告", "管理", "登记", "流程", "审核")
_NOISE_SQL = "regexp_matches(term, '严防|商业|疫情监测|自我监测|人员|原则|病例|法规|报告|管理|登记|流程|审核')"


@query("term_dictionary", f"SELECT DISTINCT trim(term) AS term, length(trim(term))::INT AS n FROM term_dict WHERE length(trim(term)) >= 2 AND NOT {_NOISE_SQL}")
def term_dictionary(spark, folder):
    """Usable dictionary terms, longest first."""
    t = table(spark, folder, "term_dict", ["term"]).select(F.trim("term").alias("term")).where((F.length("term") >= 2) & ~F.col("term").rlike("|".join(NOISE_PARTS))).distinct()
    return t.select("term", F.length("term").alias("n")).orderBy(F.desc("n"), "term")


# ---------------------------------------------------------------- order and splits


@query("budget_cap", "SELECT doc_id, CASE WHEN b + length(text) <= 200000 THEN length(text) ELSE 200000 - b END::BIGINT AS taken, b::BIGINT AS before FROM (SELECT doc_id, text, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS b FROM documents WHERE length(text) > 0) WHERE b < 200000")
def budget_cap(spark, folder):
    """Documents until the budget, the last one cut."""
    out = order.budget_cap(docs(spark, folder).select("doc_id", "text"), "doc_id", "text", 200_000)
    return out.select("doc_id", F.length("text").cast("long").alias("taken"), "before")


@query("offsets", "SELECT doc_id, (sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id) - octet_length(encode(coalesce(text, ''))))::BIGINT AS first_byte FROM documents")
def offsets(spark, folder):
    """Offset table of a blob."""
    d = docs(spark, folder).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return order.running_before(d, [F.col("doc_id")], F.col("size"), "first_byte").select("doc_id", "first_byte")


@query("tail_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.01)) THEN 'val' ELSE 'train' END AS split FROM documents")
def tail_split(spark, folder):
    """The tail is held out."""
    return order.tail_split(docs(spark, folder).select("doc_id"), [F.col("doc_id")], 0.01).select("doc_id", "split")


@query("head_split", "SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(id::VARCHAR || '|42'), id) <= 100 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT id FROM format_data)")
def head_split(spark, folder):
    """The first rows of a seeded shuffle are held out."""
    ids = table(spark, folder, "format_data", ["id"]).distinct().withColumn("h", order.hash_order(F.col("id"), 42))
    return order.numbered(ids, [F.col("h"), F.col("id")]).select("id", F.when(F.col("rn") <= 100, "val").otherwise("train").alias("split"))


@query("quota_sample", "SELECT id FROM (SELECT DISTINCT id FROM format_data) ORDER BY md5(id::VARCHAR || '|7'), id LIMIT 500")
def quota_sample(spark, folder):
    """A seeded sample of fixed size."""
    return order.quota_sample(table(spark, folder, "format_data", ["id"]).distinct(), "id", 7, 500)


@query("first_per_question", "SELECT question, min(id) AS id FROM format_data WHERE question IS NOT NULL GROUP BY question")
def first_per_question(spark, folder):
    """The first record of each question, as a minimum combined before the shuffle."""
    return table(spark, folder, "format_data", ["id", "question"]).where("question is not null").groupBy("question").agg(F.min("id").alias("id"))


@query("sequential_ids", "SELECT id, 9999999 + row_number() OVER (ORDER BY id) AS eid FROM (SELECT DISTINCT id FROM format_data)")
def sequential_ids(spark, folder):
    """W7."""
    return order.numbered(table(spark, folder, "format_data", ["id"]).distinct(), [F.col("id")]).select("id", (F.col("rn") + 9999999).alias("eid"))


@query("budgeted_union", "SELECT origin, id FROM (SELECT 'guide' AS origin, doc_id AS id, 0 AS p FROM documents WHERE source LIKE 'guide%' UNION ALL SELECT 'kb', id, 1 FROM (SELECT DISTINCT id FROM format_data)) ORDER BY p, id LIMIT 1100")
def budgeted_union(spark, folder):
    """Guides first, then the knowledge base up to the quota."""
    g = docs(spark, folder).where("source like 'guide%'").select(F.lit("guide").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).alias("p"))
    k = table(spark, folder, "format_data", ["id"]).distinct().select(F.lit("kb").alias("origin"), "id", F.lit(1).alias("p"))
    return g.unionByName(k).orderBy("p", "id").limit(1100).select("origin", "id")


@query("unseen_questions", "SELECT DISTINCT qa_id FROM deepseek_qa q WHERE question IS NOT NULL AND NOT EXISTS (SELECT 1 FROM format_data f WHERE f.question = q.question)")
def unseen_questions(spark, folder):
    """Generated questions that the knowledge base does not hold yet."""
    q = table(spark, folder, "deepseek_qa", ["qa_id", "question"]).where("question is not null")
    return q.join(table(spark, folder, "format_data", ["question"]), "question", "left_anti").select("qa_id").distinct()


# ---------------------------------------------------------------- vocabulary and tokens

_VOCAB = "SELECT ch AS token, n, 3 + row_number() OVER (ORDER BY n DESC, ch) AS id FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0) GROUP BY ch ORDER BY n DESC, ch LIMIT 997) WHERE n >= 2"


def vocabulary(spark, folder, size: int = 1000, least: int = 2) -> DataFrame:
    """The most common characters; ids follow four specials."""
    c = docs(spark, folder).where(F.length("text") > 0).select(F.explode(F.split("text", "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "token").limit(size - 3)
    return top.where(F.col("n") >= least).withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 3)


QUERIES["char_vocabulary"], ORACLES["char_vocabulary"] = vocabulary, _VOCAB


@query("encode_chars", f"SELECT d.doc_id, d.pos, coalesce(v.id, 1)::BIGINT AS token FROM (SELECT doc_id, unnest(range(1, len(c) + 1)) AS pos, unnest(c) AS ch FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0)) d LEFT JOIN ({_VOCAB}) v ON v.token = d.ch")
def encode_chars(spark, folder):
    """Character ids, unknown ones 1."""
    d = docs(spark, folder).where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "")).alias("p", "token"))
    v = vocabulary(spark, folder).select("token", "id")
    return d.join(F.broadcast(v), "token", "left").select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.coalesce("id", F.lit(1)).cast("long").alias("token"))


def encoded(spark, folder) -> DataFrame:
    """(doc_id, ids) of all texts, begin and end marked; grouped by the key alone."""
    d = docs(spark, folder).where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "")).alias("p", "token"))
    v = vocabulary(spark, folder).select("token", "id")
    rows = d.join(F.broadcast(v), "token", "left").select("doc_id", F.struct("p", F.coalesce("id", F.lit(instruct.UNK)).alias("id")).alias("c"))
    ids = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["id"]).alias("ids"))
    return ids.select("doc_id", F.concat(F.array(F.lit(instruct.BOS)), "ids", F.array(F.lit(instruct.EOS))).alias("ids"))


_IDS = f"(SELECT d.doc_id, d.pos, coalesce(v.id, 1)::BIGINT AS token FROM (SELECT doc_id, unnest(range(1, len(c) + 1)) AS pos, unnest(c) AS ch FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0)) d LEFT JOIN ({_VOCAB}) v ON v.token = d.ch)"


@query("encode_whole", f"SELECT doc_id, '2,' || string_agg(token, ',' ORDER BY pos) || ',3' AS ids FROM {_IDS} GROUP BY doc_id")
def encode_whole(spark, folder):
    """Ids of whole texts with their marks."""
    return encoded(spark, folder).select("doc_id", F.array_join("ids", ",").alias("ids"))


@query("decode_whole", f"SELECT doc_id, coalesce(string_agg(v.token, '' ORDER BY i.pos) FILTER (WHERE v.token IS NOT NULL), '') AS text FROM {_IDS} i LEFT JOIN ({_VOCAB}) v ON v.id = i.token GROUP BY doc_id")
def decode_whole(spark, folder):
    """Ids back to text, up to the end mark; unknown ids and padding leave nothing."""
    ids = encoded(spark, folder).select("doc_id", F.posexplode(instruct.up_to_end(F.col("ids"))).alias("p", "id"))
    v = vocabulary(spark, folder).select("token", "id")
    back = ids.join(F.broadcast(v), "id", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("p", "token")))).alias("l"))
    return back.select("doc_id", F.array_join(F.transform("l", lambda x: x["token"]), "").alias("text"))


@query("next_tokens", "SELECT doc_id, pos, ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS label FROM (SELECT doc_id, unnest(range(1, len(c) + 1)) AS pos, unnest(c) AS ch FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0))")
def next_tokens(spark, folder):
    """The label of a position is the next token."""
    c = docs(spark, folder).where(F.length("text") > 0).select("doc_id", F.split("text", "").alias("c"))
    z = c.select("doc_id", F.posexplode(F.arrays_zip("c", F.slice("c", F.lit(2), F.size("c")).alias("n"))).alias("p", "z"))
    return z.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("z.c").alias("ch"), F.col("z.n").alias("label"))


@query("marker_tokens", f"SELECT id, len(regexp_extract_all('<user>' || question || '<end><assistant>' || answer || '<end>', '(<user>|<assistant>|<end>|(?s:.))', 1))::INT AS tokens FROM {_KB}")
def marker_tokens(spark, folder):
    """T4, B1: markers are one token each."""
    return kb(spark, folder).select("id", F.size(instruct.marker_tokens(instruct.sample_text(F.col("question"), F.col("answer")))).alias("tokens"))


# ---------------------------------------------------------------- instruction records


@query("raft_evidence", f"SELECT id, substr(answer, 1, 60) AS e1, coalesce(nullif(substr(answer, 61, 60), ''), substr(answer, 1, 60)) AS e2 FROM {_KB}")
def raft_evidence(spark, folder):
    """B4, C18, R10."""
    one, two = instruct.evidence(F.col("answer"))
    return kb(spark, folder).select("id", one.alias("e1"), two.alias("e2"))


@query("heading_sections", r"SELECT doc_id, section, any_value(heading) FILTER (WHERE h) AS heading, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h) AS body FROM (SELECT *, regexp_replace(line, '^#{1,6}\s+', '') AS heading, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM (SELECT *, regexp_matches(line, '^#{1,6}\s+\S') AS h FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))) WHERE section > 0 GROUP BY doc_id, section")
def heading_sections(spark, folder):
    """Sections opened by headings."""
    s = instruct.sections(docs(spark, folder).where("text is not null"), "doc_id", "text")
    return s.select("doc_id", F.col("section").cast("long").alias("section"), "heading", F.nullif("body", F.lit("")).alias("body"))


ORACLES["heading_sections"] = "SELECT doc_id, section::BIGINT AS section, heading, nullif(body, '') AS body FROM (" + ORACLES["heading_sections"] + ")"


_TITLES = r"SELECT doc_id, trim(regexp_replace(regexp_replace(l, '^#{1,6}\s+', ''), '^[0-9\s.．、-]+', '')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '^#{1,6}\s+\S')"
_GUIDED = "regexp_matches(t, '诊断|治疗|预防|指南|规范|用药|管理|处理')"


@query("heading_questions", f"SELECT DISTINCT doc_id, unnest(CASE WHEN {_GUIDED} THEN ['根据临床指南，' || t || '的内容要点有哪些', t || '，具体应如何实施'] ELSE [t || '的临床诊疗要点是什么', '临床实践中，' || t || '应如何处理'] END) AS question FROM ({_TITLES}) WHERE length(t) BETWEEN 2 AND 40")
def heading_questions(spark, folder):
    """Two questions from each heading."""
    l = docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"^#{1,6}\s+\S"))
    return l.select("doc_id", F.explode(instruct.heading_questions(F.regexp_replace("l", r"^#{1,6}\s+", ""))).alias("question")).distinct()


@query("sentence_filter", "SELECT doc_id, count(*) AS sentences FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[。！？\\n]+')) AS s FROM documents) WHERE length(s) BETWEEN 20 AND 200 GROUP BY doc_id")
def sentence_filter(spark, folder):
    """Sentences of a usable length."""
    s = docs(spark, folder).select("doc_id", F.explode(F.split("text", "[。！？\\n]+")).alias("s")).where(F.length("s").between(20, 200))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"))


# ---------------------------------------------------------------- retrieval


def _index(spark, folder):
    """Entries, postings of their character index and the number of entries."""
    k = kb(spark, folder)
    post = search.postings(k, "id", search.chars(F.concat("question", F.substring("answer", 1, 40))))
    return k, post, k.count()


def _q_table(spark, folder):
    return table(spark, folder, "retrieval_query", ["query_id", "text"])


_CHARS = r"list_filter(string_split({t}, ''), lambda c: NOT regexp_matches(c, '^[\s\x{{3000}}]*$'))"
_POST = f"(SELECT DISTINCT id AS doc_id, unnest({_CHARS.format(t='question || substr(answer, 1, 40)')}) AS term FROM {_KB})"
_IDF = f"(SELECT term, count(DISTINCT doc_id) AS df, least(floor(64 * ln(1 + (SELECT count(DISTINCT id) FROM {_KB}) / count(DISTINCT doc_id))), 255)::INT AS idf FROM {_POST} GROUP BY term)"


def _retrieve_sql(k: int, distinct: bool = True) -> str:
    q = f"(SELECT {'DISTINCT' if distinct else ''} query_id, unnest({_CHARS.format(t='text')}) AS term FROM retrieval_query)"
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, sum(idf)::BIGINT AS score FROM {q} q JOIN {_IDF} i USING (term) JOIN {_POST} p USING (term) GROUP BY query_id, doc_id)) WHERE rank <= {k}"


@query("char_idf", f"SELECT term, df, idf FROM {_IDF}")
def char_idf(spark, folder):
    """A2-A4, R1, R3, U4, O5."""
    _, post, n = _index(spark, folder)
    return search.idf(post, n)


@query("retrieve_top3", _retrieve_sql(3))
def retrieve_top3(spark, folder):
    """A batch of queries against the character index."""
    _, post, n = _index(spark, folder)
    return search.retrieve(post, n, _q_table(spark, folder), search.chars(F.col("text")), 3)


FLAGSHIP = retrieve_top3


@query("retrieve_multiset", _retrieve_sql(3, distinct=False))
def retrieve_multiset(spark, folder):
    """Repeated query characters count again."""
    _, post, n = _index(spark, folder)
    return search.retrieve(post, n, _q_table(spark, folder), search.chars(F.col("text")), 3, distinct=False)


@query("evidence_fetch", f"SELECT r.query_id, r.rank, r.doc_id, substr(k.answer, 1, 40) AS evidence FROM ({_retrieve_sql(3)}) r JOIN (SELECT id, min(answer) AS answer FROM {_KB} GROUP BY id) k ON k.id = r.doc_id")
def evidence_fetch(spark, folder):
    """The texts of the top documents."""
    k = kb(spark, folder).groupBy("id").agg(F.min("answer").alias("answer"))
    top = retrieve_top3(spark, folder)
    wanted = top.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("query_id", "rank")).alias("at"))
    found = sized_join(k, wanted, ["id"]).select("id", F.substring("answer", 1, 40).alias("evidence"), F.explode("at").alias("at"))
    return found.select("at.query_id", "at.rank", F.col("id").alias("doc_id"), "evidence")


@query("query_coverage", f"SELECT query_id, count(*) AS terms, count(i.term) AS known FROM (SELECT DISTINCT query_id, unnest({_CHARS.format(t='text')}) AS term FROM retrieval_query) q LEFT JOIN {_IDF} i USING (term) GROUP BY query_id")
def query_coverage(spark, folder):
    """How much of a query the index knows."""
    wanted = search.by_term(_q_table(spark, folder), search.chars(F.col("text")))
    known = sized_join(_index(spark, folder)[1].select("term"), wanted.select("term"), ["term"], "left_semi").distinct().withColumn("hit", F.lit(1))
    each = wanted.join(known, "term", "left").select(F.explode("queries").alias("query_id"), "hit")
    return each.groupBy("query_id").agg(F.count("*").alias("terms"), F.count("hit").alias("known"))


_TERMS = f"(SELECT DISTINCT trim(term) AS term FROM term_dict WHERE length(trim(term)) >= 2 AND NOT {_NOISE_SQL})"
_ALT = f"(SELECT '(' || string_agg(regexp_replace(term, '([-.+*?^$|()\\[\\]{{}}\\\\])', '\\\\\\1', 'g'), '|' ORDER BY length(term) DESC, term) || ')' FROM {_TERMS})"
_OVER = f"(SELECT DISTINCT id AS doc_id, unnest(regexp_extract_all(replace(question || substr(answer, 1, 80), chr(10), ''), {_ALT}, 1)) AS term FROM {_KB})"


def _overlay(spark, folder):
    """Dictionary, its postings in the entries, and the dictionary terms of the queries."""
    terms = term_dictionary(spark, folder).select("term")
    k = kb(spark, folder).select("id", F.regexp_replace(F.concat("question", F.substring("answer", 1, 80)), "\n", "").alias("t"))
    post = search.postings(search.longest_matches(k, "id", "t", terms), "id", F.col("terms"))
    return post, search.longest_matches(_q_table(spark, folder), "query_id", "text", terms)


@query("overlay_terms", f"SELECT term, count(*) AS docs FROM {_OVER} GROUP BY term")
def overlay_terms(spark, folder):
    """Documents of each dictionary term by forward longest match."""
    return _overlay(spark, folder)[0].groupBy("term").agg(F.count("*").alias("docs"))


@query("overlay_rank", f"SELECT query_id, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS r FROM (SELECT query_id, doc_id, count(*) AS hits FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(text, {_ALT}, 1)) AS term FROM retrieval_query) q JOIN {_OVER} o USING (term) GROUP BY query_id, doc_id)) WHERE r = 1")
def overlay_rank(spark, folder):
    """The document with most distinct dictionary terms."""
    post, asked = _overlay(spark, folder)
    scored = search.hits(post, search.by_term(asked, F.col("terms"))).groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    return search.best(scored, 1).select("query_id", "doc_id", F.col("score").alias("hits"))


@query("overlay_boost", f"SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, sum(s)::BIGINT AS score FROM (SELECT query_id, doc_id, idf AS s FROM (SELECT DISTINCT query_id, unnest({_CHARS.format(t='text')}) AS term FROM retrieval_query) q JOIN {_IDF} i USING (term) JOIN {_POST} p USING (term) UNION ALL SELECT query_id, doc_id, 600 FROM (SELECT query_id, unnest(regexp_extract_all(text, {_ALT}, 1)) AS term FROM retrieval_query) q JOIN {_OVER} o USING (term)) GROUP BY query_id, doc_id)) WHERE r <= 3")
def overlay_boost(spark, folder):
    """Characters plus 600 for every dictionary term of the query."""
    _, post, n = _index(spark, folder)
    over, asked = _overlay(spark, folder)
    wanted = search.by_term(_q_table(spark, folder), search.chars(F.col("text")))
    mine = sized_join(post, wanted.select("term"), ["term"], "left_semi")
    weighted = sized_join(wanted, search.idf(mine, n).select("term", "idf"), ["term"])
    by_char = sized_join(mine, weighted, ["term"]).select("doc_id", F.explode("queries").alias("query_id"), F.col("idf").alias("s"))
    by_word = search.hits(over, search.by_term(asked, F.col("terms"), distinct=False)).select("doc_id", "query_id", F.lit(600).alias("s"))
    total = by_char.unionByName(by_word).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))
    return search.best(total, 3).select("query_id", "doc_id", "score")


# Words without weight in the word index.
STOP_WORDS = tuple("的了是在和有就不都而及与或一个中其，。、；：！？")


def _words_sql(t: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all({t}, {_ALT}, 1), regexp_extract_all(lower({t}), '[a-z]{{2,}}')))"


_WORD_POST = f"(SELECT DISTINCT id AS doc_id, unnest({_words_sql('question || substr(answer, 1, 60)')}) AS term FROM {_KB})"


@query("word_top2", f"SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, sum(idf)::BIGINT AS score FROM (SELECT DISTINCT query_id, unnest({_words_sql('text')}) AS term FROM retrieval_query) q JOIN (SELECT term, least(floor(64 * ln(1 + (SELECT count(DISTINCT id) FROM {_KB}) / count(DISTINCT doc_id))), 255) AS idf FROM {_WORD_POST} GROUP BY term) i USING (term) JOIN {_WORD_POST} p USING (term) GROUP BY query_id, doc_id)) WHERE r <= 2")
def word_top2(spark, folder):
    """The word index (dictionary words and words of Latin letters) without stop words."""
    dictionary = term_dictionary(spark, folder).select("term")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def words(df, key, text):
        latin = df.select(key, F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2,})"), F.lit(1)).alias("terms"))
        each = search.longest_matches(df, key, text, dictionary).unionByName(latin).select(key, F.explode(F.array_except("terms", stop)).alias("term"))
        return each.distinct()

    k = kb(spark, folder).select("id", F.concat("question", F.substring("answer", 1, 60)).alias("t"))
    asked = words(_q_table(spark, folder), "query_id", "text").groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    post = words(k, "id", "t").withColumnRenamed("id", "doc_id")
    return search.retrieve(post, k.count(), asked, F.col("terms"), 2).select("query_id", "doc_id", "score")


# ---------------------------------------------------------------- arrays


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings", ["vec_id", "embedding"])


_CELLS = "(SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _quant_sql(bits: int, size: int) -> str:
    top = 2 ** (bits - 1) - 1
    return f"SELECT vec_id, pos::INT AS pos, greatest(least(round_even(x / s, 0), {top}), -{top})::INT AS code FROM (SELECT *, greatest(max(abs(x)) OVER (PARTITION BY vec_id, pos // {size}) / {top}.0::DOUBLE, 1e-8) AS s FROM {_CELLS})"


def _quantized(bits: int, size: int):
    def run(spark, folder):
        v = _vectors(spark, folder).select("vec_id", F.posexplode(arrays.quantize(F.col("embedding"), size, bits)).alias("pos", "code"))
        return v

    return run


for _bits, _size in ((4, 32), (8, 32), (8, 64)):
    QUERIES[f"quantize_{_bits}_{_size}"], ORACLES[f"quantize_{_bits}_{_size}"] = _quantized(_bits, _size), _quant_sql(_bits, _size)


@query("pack_nibbles", f"SELECT vec_id, (pos // 2)::INT AS pos, sum((code + 8) * CASE WHEN pos % 2 = 0 THEN 1 ELSE 16 END)::INT AS byte FROM ({_quant_sql(4, 32)}) GROUP BY vec_id, pos // 2")
def pack_nibbles(spark, folder):
    """N2."""
    return _vectors(spark, folder).select("vec_id", F.posexplode(arrays.pack_nibbles(arrays.quantize(F.col("embedding"), 32, 4))).alias("pos", "byte"))


@query("quantize_error", f"SELECT q.vec_id, round(max(abs(c.x - q.code * s.s)), 6) AS worst FROM ({_quant_sql(4, 32)}) q JOIN {_CELLS} c ON c.vec_id = q.vec_id AND c.pos = q.pos JOIN (SELECT vec_id, pos // 32 AS g, greatest(max(abs(x)) / 7.0::DOUBLE, 1e-8) AS s FROM {_CELLS} GROUP BY 1, 2) s ON s.vec_id = q.vec_id AND s.g = q.pos // 32 GROUP BY q.vec_id")
def quantize_error(spark, folder):
    """Largest difference after quantising and back."""
    v = _vectors(spark, folder).select("vec_id", arrays.doubles(F.col("embedding")).alias("x"), arrays.quantize(F.col("embedding"), 32, 4).alias("q"), arrays.scales(F.col("embedding"), 32, 4).alias("s"))
    return v.select("vec_id", F.round(F.array_max(F.zip_with("x", arrays.dequantize(F.col("q"), F.col("s"), 32), lambda a, b: F.abs(a - b))), 6).alias("worst"))


@query("norms_and_dots", f"SELECT vec_id, round(sum(x * x), 6) AS dot, round(1 / sqrt(sum(x * x) / count(*) + 1e-6), 6) AS rms_factor, round(ln(sum(exp(x))) - min(x) FILTER (WHERE pos = 0), 6) AS ce FROM {_CELLS} GROUP BY vec_id")
def norms_and_dots(spark, folder):
    """N8, N10, N13, A14."""
    e = F.col("embedding")
    square = arrays.dot(e, e)
    return _vectors(spark, folder).select("vec_id", F.round(square, 6).alias("dot"), F.round(1 / F.sqrt(square / F.size(e) + 1e-6), 6).alias("rms_factor"), F.round(arrays.cross_entropy(e, F.lit(0)), 6).alias("ce"))


@query("softmax_long", f"SELECT vec_id, pos::INT AS pos, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 7) AS p FROM {_CELLS}")
def softmax_long(spark, folder):
    """N16."""
    return _vectors(spark, folder).select("vec_id", F.posexplode(arrays.softmax(F.col("embedding"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 7).alias("p"))


@query("top_k_ties", f"SELECT vec_id, count(*)::INT AS kept, round(min(x), 6) AS floor FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM {_CELLS}) WHERE r <= 5 GROUP BY vec_id")
def top_k_ties(spark, folder):
    """Values at or above the fifth."""
    k = arrays.top_k_kept(F.col("embedding"), 5)
    return _vectors(spark, folder).select("vec_id", F.size(k).alias("kept"), F.round(F.array_min(k), 6).alias("floor"))


@query("argmax", f"SELECT vec_id, min(pos)::INT AS best FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM {_CELLS}) WHERE x = m GROUP BY vec_id")
def argmax(spark, folder):
    """The first maximum wins."""
    return _vectors(spark, folder).select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


# ---------------------------------------------------------------- reports


@query("missing_characters", f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(answer, '')) AS ch FROM {_KB}) t WHERE NOT EXISTS (SELECT 1 FROM ({_VOCAB}) v WHERE v.token = t.ch) GROUP BY ch")
def missing_characters(spark, folder):
    """Characters of the answers that the vocabulary lacks."""
    c = kb(spark, folder).select(F.explode(F.split("answer", "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(vocabulary(spark, folder).select("token")), "token", "left_anti").select(F.col("token").alias("ch"), "n")


@query("source_spread", "SELECT source, round(avg(n_chars), 6) AS mean, (max(n_chars) - min(n_chars)) / 2.0 AS half_range, count(*) AS n FROM documents GROUP BY source")
def source_spread(spark, folder):
    """Mean, half range and count of a measure by group."""
    return docs(spark, folder).groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), ((F.max("n_chars") - F.min("n_chars")) / 2.0).alias("half_range"), F.count("*").alias("n"))


@query("repeated_keys", "SELECT id, count(*) AS n FROM format_data GROUP BY id HAVING count(*) > 1")
def repeated_keys(spark, folder):
    """Keys that come more than once."""
    return table(spark, folder, "format_data", ["id"]).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("best_so_far", "SELECT event_id, user_id, round(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS best FROM events")
def best_so_far(spark, folder):
    """Running minimum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, folder, "events", ["event_id", "user_id", "ts", "value"]).select("event_id", "user_id", F.round(F.min("value").over(w), 6).alias("best"))


@query("text_ratio", "SELECT lang, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars, round(sum(octet_length(encode(text)))::DOUBLE / sum(length(text)), 6) AS ratio FROM documents WHERE length(text) > 0 GROUP BY lang")
def text_ratio(spark, folder):
    """Ratio of sums."""
    d = docs(spark, folder).where(F.length("text") > 0)
    b, c = F.sum(F.octet_length("text")), F.sum(F.length("text"))
    return d.groupBy("lang").agg(b.alias("bytes"), c.alias("chars"), F.round(b / c, 6).alias("ratio"))
