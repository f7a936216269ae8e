"""Registered queries: instruction records with real ids, prompts, sampling of records, questions from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import instruct, order
from quern.plans import catalog as c
from quern.plans.catalog import query
from quern.plans.cleaning import _PAIRS, pairs
from quern.sources.tables import table

MARKERS = ("<user>", "<assistant>", "<end>")
_PATTERN = "(<user>|<assistant>|<end>|(?s:.))"
_MARKED = f"SELECT token, n, id FROM ({c._VOCAB}) UNION ALL SELECT m, 0, 3 + k + (SELECT count(*) FROM ({c._VOCAB})) FROM (VALUES ('<user>', 1), ('<assistant>', 2), ('<end>', 3)) x(m, k)"


def marked_vocabulary(spark, folder) -> DataFrame:
    """The vocabulary with the three markers behind it; its size is a parameter, not the corpus'."""
    v = c.vocabulary(spark, folder)
    n = v.count()
    extra = spark.createDataFrame([(m, 0, n + 4 + k) for k, m in enumerate(MARKERS)], "token string, n long, id int")
    return v.select("token", "n", "id").unionByName(extra)


@query("marked_vocabulary", _MARKED)
def marked(spark, folder):
    """Four specials, characters, markers."""
    return marked_vocabulary(spark, folder)


@query("marker_migration", f"SELECT token, id FROM ({c._VOCAB}) UNION ALL SELECT m, 3 + k + (SELECT count(*) FROM ({c._VOCAB})) FROM (VALUES ('<user>', 1), ('<assistant>', 2), ('<end>', 3)) x(m, k)")
def marker_migration(spark, folder):
    """Markers of an older form go, the present ones are appended."""
    old = c.vocabulary(spark, folder).select("token", "id").unionByName(spark.createDataFrame([("<|user|>", 5001), ("<|assistant|>", 5002), ("<|end|>", 5003)], "token string, id int"))
    legacy = spark.createDataFrame([("<|user|>",), ("<|assistant|>",), ("<|end|>",)], "token string")
    kept = old.join(F.broadcast(legacy), "token", "left_anti")
    n = kept.count()
    return kept.unionByName(spark.createDataFrame([(m, n + 4 + k) for k, m in enumerate(MARKERS)], "token string, id int"))


def ids_of(rows: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, keep: list[str]) -> DataFrame:
    """(key, ids, *keep): the ids of token arrays, unknown ones 1; only keys, positions and ids are shuffled."""
    each = rows.select(key, *keep, F.posexplode(tokens).alias("p", "token")).join(F.broadcast(vocabulary.select("token", F.col("id").alias("_v"))), "token", "left")
    return each.groupBy(key, *keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("_v", F.lit(instruct.UNK)).alias("id")))), lambda x: x["id"]).alias("ids"))


def samples(spark, folder) -> DataFrame:
    """(id, input_ids, labels) of the knowledge base."""
    prefix = instruct.marker_tokens(F.concat(F.lit("<user>"), "question", F.lit("<end><assistant>")))
    answer = instruct.marker_tokens(F.concat("answer", F.lit("<end>")))
    k = c.kb(spark, folder).select("id", prefix.alias("a"), answer.alias("b")).select("id", F.concat("a", "b").alias("t"), F.size("a").alias("n"))
    ids = ids_of(k, "id", F.col("t"), marked_vocabulary(spark, folder), ["n"])
    one, two = instruct.label_rule(F.slice("ids", F.lit(1), F.col("n")), F.slice("ids", F.col("n") + 1, F.size("ids")))
    return ids.select("id", one.alias("input_ids"), two.alias("labels"))


_SAMPLES = f"""(SELECT id, [2] || list(tok ORDER BY pos) || [3] AS input_ids, list(CASE WHEN pos > n THEN tok ELSE -100 END ORDER BY pos) || [3, -100] AS labels FROM (
    SELECT t.id, t.n, t.pos, coalesce(v.id, 1)::INT AS tok FROM (SELECT id, len(a) AS n, unnest(range(1, len(a) + len(b) + 1)) AS pos, unnest(a || b) AS ch FROM (
    SELECT id, regexp_extract_all('<user>' || question || '<end><assistant>', '{_PATTERN}', 1) AS a, regexp_extract_all(answer || '<end>', '{_PATTERN}', 1) AS b FROM {c._KB})) t LEFT JOIN ({_MARKED}) v ON v.token = t.ch) GROUP BY id)"""


@query("encoded_samples", f"SELECT id, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM {_SAMPLES}")
def encoded_samples(spark, folder):
    """Ids and labels of marked samples."""
    return samples(spark, folder).select("id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"))


@query("collated_samples", f"SELECT id, array_to_string(list_resize(input_ids[1:96], 96, 0), ',') AS input_ids, array_to_string(list_resize(labels[1:96], 96, -100), ',') AS labels FROM {_SAMPLES}")
def collated_samples(spark, folder):
    """Cut and padded, labels with the ignored value."""
    s = samples(spark, folder)
    return s.select("id", F.array_join(instruct.padded(F.col("input_ids"), instruct.PAD, 96), ",").alias("input_ids"), F.array_join(instruct.padded(F.col("labels"), instruct.IGNORE, 96), ",").alias("labels"))


_TURNS = "(SELECT segment_idx, string_agg(question, chr(10) ORDER BY qa_id) AS q, string_agg(answer, chr(10) ORDER BY qa_id) AS a FROM (SELECT DISTINCT qa_id, segment_idx, question, answer FROM deepseek_qa WHERE segment_idx IS NOT NULL) GROUP BY segment_idx)"


@query("joined_messages", f"SELECT segment_idx, '<user>' || q || '<end><assistant>' || a || '<end>' AS sample, length(q)::INT AS asked, length(a)::INT AS answered FROM {_TURNS} WHERE length(q) >= 5 AND length(a) >= 30")
def joined_messages(spark, folder):
    """B1: parts of each side joined in order, short samples dropped, the template applied."""
    t = table(spark, folder, "deepseek_qa", ["qa_id", "segment_idx", "question", "answer"]).where("segment_idx is not null").dropDuplicates(["qa_id"])
    g = t.groupBy("segment_idx").agg(F.array_sort(F.collect_list(F.struct("qa_id", "question", "answer"))).alias("l"))
    side = lambda name: F.array_join(F.transform("l", lambda x: x[name]), "\n")
    g = g.select("segment_idx", side("question").alias("q"), side("answer").alias("a")).where((F.length("q") >= 5) & (F.length("a") >= 30))
    return g.select("segment_idx", instruct.sample_text(F.col("q"), F.col("a")).alias("sample"), F.length("q").alias("asked"), F.length("a").alias("answered"))


@query(
    "raft_prompts",
    f"""SELECT id, '<user>' || substr(answer, 1, 60) || chr(10) || CASE WHEN length(answer) > 60 THEN substr(answer, 61, 60) ELSE substr(answer, 1, 60) END || chr(10) || question || '<end><assistant>' AS two,
    '<user>[证据]' || substr(answer, 1, 60) || '[/证据]<end><assistant>' AS wrapped, '<user>' || substr(answer, 1, 60) || '<end><assistant>' AS bare FROM {c._KB}""",
)
def raft_prompts(spark, folder):
    """Two evidence slices and the question, the slice in marks, the slice alone."""
    one, two = instruct.evidence(F.col("answer"))
    wrap = lambda *parts: F.concat(F.lit("<user>"), *parts, F.lit("<end><assistant>"))
    return c.kb(spark, folder).select("id", wrap(one, F.lit("\n"), two, F.lit("\n"), F.col("question")).alias("two"), wrap(F.lit("[证据]"), one, F.lit("[/证据]")).alias("wrapped"), wrap(one).alias("bare"))


# Rules by which questions are put in other words, in order.
SYNONYMS = (
    (r"^(.*?)如何治疗$", "怎么治", 1), (r"^(.*?)如何治疗$", "的治疗方法", 1), (r"^(.*?)是什么$", "什么是", 0), (r"^(.*?)有哪些$", "包括哪些", 1), (r"^(.*?)有哪些$", "列举", 0),
    (r"^(.*?)的临床表现$", "有什么症状", 1), (r"^(.*?)的临床表现$", "的典型表现", 1), (r"^(.*?)的预防措施$", "如何预防", 0), (r"^(.*?)的禁忌证$", "的禁忌情况", 1), (r"^(.*?)的适应证$", "哪些情况适合", 0),
    (r"^(.*?)怎么(.*)$", "如何", 2), (r"^(.*?)如何处理$", "的处理原则", 1), (r"^(.*?)的标准$", "的诊断标准", 1), (r"^(.*?)的流程$", "的流程是什么", 1), (r"^(.*?)制度$", "制度的内容", 1),
    (r"^(.*?)报告$", "报告的主要内容", 1), (r"^(.*?)要求$", "的要求有哪些", 1), (r"^(.*?)规定$", "的规定是什么", 1), (r"^(.*?)区别$", "的区别是什么", 1), (r"^(.*?)如何(.*)$", "怎么", 2),
)
_FORM = {0: ("{w}$1", "{w}\\1"), 1: ("$1{w}", "\\1{w}"), 2: ("$1{w}$2", "\\1{w}\\2")}
_ENDINGS = ("如何治疗", "是什么", "有哪些", "的流程", "怎么办才好", "制度", "的临床表现", "如何处理")


def synonym_variants(q: Column, most: int = 3) -> Column:
    """Up to `most` variants of a question by the rules in order, 5 to 100 characters long and different from it."""
    said = F.array(*[F.when(q.rlike(p), F.regexp_replace(q, p, _FORM[kind][0].format(w=w))) for p, w, kind in SYNONYMS])
    return F.slice(F.filter(said, lambda v: v.isNotNull() & (v != q) & F.length(v).between(5, 100)), 1, most)


_ASKED = f"(SELECT id, regexp_replace(coalesce(label, 'x'), '\\s', '', 'g') || CASE id % 8 {' '.join(f'WHEN {k} THEN {c._q(e)}' for k, e in enumerate(_ENDINGS))} END AS q FROM (SELECT DISTINCT id, label FROM format_data))"
_SAID = ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN regexp_replace(q, '{p}', '{_FORM[kind][1].format(w=w)}') END" for p, w, kind in SYNONYMS)


@query("synonyms", f"SELECT id, unnest(list_slice(list_filter([{_SAID}], lambda v: v IS NOT NULL AND v <> q AND length(v) BETWEEN 5 AND 100), 1, 3)) AS variant FROM {_ASKED}")
def synonyms(spark, folder):
    """Questions in other words."""
    f = table(spark, folder, "format_data", ["id", "label"]).dropDuplicates(["id"])
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("id") % 8 + 1).cast("int"))
    q = f.select("id", F.concat(F.regexp_replace(F.coalesce("label", F.lit("x")), r"\s", ""), end).alias("q"))
    return q.select("id", F.explode(synonym_variants(F.col("q"))).alias("variant"))


@query("mixed_sampling", "SELECT id, CASE WHEN substr(md5(id::VARCHAR || '|5'), 1, 8) < 'cccccccd' THEN 'instruction' ELSE 'continuation' END AS kind FROM (SELECT DISTINCT id FROM format_data)")
def mixed_sampling(spark, folder):
    """Four in five draws are instructions, by the hash of the draw."""
    draw = F.substring(order.hash_order(F.col("id"), 5), 1, 8)
    return table(spark, folder, "format_data", ["id"]).distinct().select("id", F.when(draw < "cccccccd", "instruction").otherwise("continuation").alias("kind"))


@query("continuation_windows", "SELECT doc_id, (doc_id * 7919) % (length(text) - 63) AS first, substr(text, ((doc_id * 7919) % (length(text) - 63) + 1)::INT, 64) AS window FROM documents WHERE length(text) >= 64")
def continuation_windows(spark, folder):
    """A window of fixed length at a hashed place of each text."""
    d = c.docs(spark, folder).where(F.length("text") >= 64).withColumn("first", F.expr("(doc_id * 7919) % (length(text) - 63)"))
    return d.select("doc_id", "first", F.expr("substring(text, cast(first + 1 as int), 64)").alias("window"))


# Aspects and the words that name them, endings of an entity, words that are none.
ASPECTS = {
    "诊断标准": ["诊断标准", "诊断依据", "诊断要点", "确诊标准"], "治疗方案": ["治疗方案", "治疗原则", "治疗方法", "治疗策略"], "临床表现": ["临床表现", "临床特征", "症状", "典型表现"],
    "并发症": ["并发症", "术后并发症"], "禁忌证": ["禁忌证", "禁忌症", "绝对禁忌"], "适应证": ["适应证", "适应症", "适应范围"], "鉴别诊断": ["鉴别诊断"], "操作步骤": ["操作步骤", "操作规程", "手术步骤"],
    "分期分级": ["分期", "分级", "TNM"], "预后": ["预后", "生存率"], "预防措施": ["预防措施", "预防方法", "防控"], "随访": ["随访", "复查"],
}
ENTITY_ENDS = "(癌|病|症|瘤|综合征|综合症|炎|痛|肿|肉瘤|肿瘤|血症|障碍|损伤|衰竭|感染|出血|梗死|坏死|病变|骨折|结核)$"
NO_ENTITY = "(的|与|和|或|及|等|中|后|前|内|外|患者|病人|临床|治疗|诊断|进行|以及|包括|根据|按照|对于|通过|采用|使用)$"


def entity_before(sentence: Column, word: str) -> Column:
    """The longest of the last 8 to 2 characters before a word that ends like an entity, holds no sign and starts with no number; null where there is none."""
    at = F.instr(sentence, word)
    before = F.substring(sentence, F.lit(1), at - 1)
    ends = F.array(*[T.strip(F.when(F.length(before) > n, F.substring(before, -n, n)).otherwise(before)) for n in range(8, 1, -1)])
    fit = F.filter(ends, lambda e: (F.length(e) >= 2) & ~e.rlike(r"^[\d\s.()（）【】\[\]一二三四五六七八九十]") & ~e.rlike(r"[，。；：？！、（）()《》\"'【】]") & e.rlike(ENTITY_ENDS) & ~e.rlike(NO_ENTITY) & ~e.rlike(r"^[\d\sA-Za-z]+$"))
    return F.when(at > 1, F.try_element_at(fit, F.lit(1)))


@query("template_questions")
def template_questions(spark, folder):
    """One question for each aspect that a sentence names after an entity; the first of a seeded order for each question. Tested against brute force."""
    s = c.docs(spark, folder).select("doc_id", F.explode(F.split("text", "[。！？\\n]+")).alias("s")).select("doc_id", T.strip(F.col("s")).alias("s")).where(F.length("s").between(20, 200))
    named = F.array(*[F.struct(F.lit(aspect).alias("aspect"), F.coalesce(*[entity_before(F.col("s"), w) for w in words]).alias("entity")) for aspect, words in ASPECTS.items()])
    each = s.select("doc_id", "s", F.explode(F.filter(named, lambda x: x["entity"].isNotNull())).alias("x"))
    asked = each.select(F.concat("x.entity", F.lit("的"), "x.aspect", F.lit("是什么？")).alias("question"), F.col("s").alias("answer"), "x.aspect", order.hash_order(F.col("doc_id"), 42).alias("h"))
    return asked.groupBy("question").agg(F.min(F.struct("h", "answer", "aspect")).alias("m")).select("question", "m.answer", "m.aspect")


# ---------------------------------------------------------------- prompts

_ROLE = "你是一个医学助手，请根据提供的参考资料准确回答问题。"
_BITS = f"(SELECT id, question, substr(answer, 1, 80) AS e FROM {_PAIRS} WHERE question <> '')"


def _chars_sql(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN [] ELSE string_split({t}, '') END)"


_HEAD_SQL = f"(['<s>'] || string_split('system' || chr(10) || '{_ROLE}', '') || ['</s>', chr(10), '<s>'] || string_split('user' || chr(10), ''))"
_TAIL_SQL = "(['</s>', chr(10), '<s>'] || string_split('assistant' || chr(10), ''))"
_ROOM = f"(100 - len({_HEAD_SQL}) - len({_chars_sql('question')}) - len({_TAIL_SQL}) - 8)"


@query("chat_prompts", f"SELECT id, array_to_string(CASE WHEN e <> '' AND {_ROOM} > 0 THEN {_HEAD_SQL} || string_split('参考资料：' || chr(10), '') || {_chars_sql('e')}[1:greatest({_ROOM}, 0)] || [chr(10), chr(10)] ELSE {_HEAD_SQL} END || {_chars_sql('question')} || {_TAIL_SQL}, '') AS prompt FROM {_BITS}")
def chat_prompts(spark, folder):
    """The evidence gives way to the limit, the question and the frame never do."""
    p = pairs(spark, folder).where("question <> ''").select("id", "question", F.substring("answer", 1, 80).alias("e"))
    return p.select("id", F.array_join(instruct.chat_ids(F.col("question"), F.col("e"), _ROLE, 100), "").alias("prompt"))


_PRESET = f"({_HEAD_SQL} || string_split('问题：', '') || {_chars_sql('question')} || {_TAIL_SQL})"


@query("preset_prompts", f"SELECT id, array_to_string(CASE WHEN len({_PRESET}) > 100 THEN {_PRESET}[1:96] || {_PRESET}[-4:] ELSE {_PRESET} END, '') AS prompt FROM {_BITS}")
def preset_prompts(spark, folder):
    """What is too long keeps its first 96 and last 4 ids."""
    p = pairs(spark, folder).where("question <> ''")
    return p.select("id", F.array_join(instruct.preset_ids(F.col("question"), _ROLE, 100), "").alias("prompt"))


_OPENED = "(['<bos>', '<user>'] || string_split(substr(answer, 1, 40) || chr(10) || substr(answer, 41, 40) || chr(10), ''))[1:104]"


@query("augmented_prompts", f"SELECT id, array_to_string(({_OPENED} || {_chars_sql('question')})[1:112] || ['<end>', '<assistant>'], '') AS prompt FROM {_PAIRS}")
def augmented_prompts(spark, folder):
    """Evidence lines first, then the question without its marks, both within the prompt's bounds."""
    p = pairs(spark, folder)
    evidence = F.array(F.substring("answer", 1, 40), F.substring("answer", 41, 40))
    return p.select("id", F.array_join(instruct.augmented_ids(evidence, F.col("question"), 120), "").alias("prompt"))


@query("stray_signs", f"SELECT id, len(regexp_extract_all('<user>>' || question || '<end>><assistant>>' || answer || '<end>>', '{_PATTERN}', 1))::INT AS tokens FROM {c._KB}")
def stray_signs(spark, folder):
    """T5: the older marker rule leaves its last sign behind as a token."""
    return c.kb(spark, folder).select("id", F.size(instruct.marker_tokens(instruct.sample_text(F.col("question"), F.col("answer")), legacy=True)).alias("tokens"))
