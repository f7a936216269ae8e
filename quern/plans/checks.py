"""Registered queries: comparisons, budgets, sampling and kernels over arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import arrays, order
from quern.plans import catalog as c
from quern.plans.catalog import _CELLS, _quant_sql, _vectors, query
from quern.sources.tables import table

_E = "embedding"


@query(
    "arm_deltas",
    "WITH m AS (SELECT event_type AS arm, avg(value) AS v FROM events GROUP BY event_type) SELECT a.arm AS a, b.arm AS b, round(b.v - a.v, 6) AS delta, CASE WHEN b.v - a.v > 0.01 THEN 'YES' WHEN b.v - a.v < -0.01 THEN 'no' ELSE 'tie' END AS verdict FROM m a JOIN m b ON a.arm < b.arm",
)
def arm_deltas(spark, folder):
    """Differences of the arms' means with a verdict; a few arms, aggregated first."""
    m = table(spark, folder, "events", ["event_type", "value"]).groupBy(F.col("event_type").alias("arm")).agg(F.avg("value").alias("v"))
    each = m.agg(F.array_sort(F.collect_list(F.struct("arm", "v"))).alias("l")).select(F.explode(F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y["arm"] > x["arm"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    d = F.col("p.y.v") - F.col("p.x.v")
    return each.select(F.col("p.x.arm").alias("a"), F.col("p.y.arm").alias("b"), F.round(d, 6).alias("delta"), F.when(d > 0.01, "YES").when(d < -0.01, "no").otherwise("tie").alias("verdict"))


_CE = f"(SELECT vec_id, ln(sum(exp(x))) - max(x) FILTER (WHERE pos = vec_id % 64) AS ce FROM {_CELLS} GROUP BY vec_id)"


@query("perplexity", f"SELECT vec_id % 4 AS batch, round(avg(ce), 6) AS loss, round(exp(avg(ce)), 5) AS perplexity FROM {_CE} GROUP BY 1")
def perplexity(spark, folder):
    """Mean cross-entropy and perplexity of each fixed batch."""
    e = _vectors(spark, folder).select("vec_id", arrays.cross_entropy(_E, (F.col("vec_id") % 64).cast("int")).alias("ce"))
    return e.groupBy((F.col("vec_id") % 4).alias("batch")).agg(F.round(F.avg("ce"), 6).alias("loss"), F.round(F.exp(F.avg("ce")), 5).alias("perplexity"))


_BACK = f"(SELECT q.vec_id, q.pos, c.x, q.code * s.s AS y FROM ({_quant_sql(4, 32)}) q JOIN {_CELLS} c ON c.vec_id = q.vec_id AND c.pos = q.pos JOIN (SELECT vec_id, pos // 32 AS g, greatest(max(abs(x)) / 7.0::DOUBLE, 1e-8) AS s FROM {_CELLS} GROUP BY 1, 2) s ON s.vec_id = q.vec_id AND s.g = q.pos // 32)"


def _back(spark, folder):
    """Vectors beside what is left of them after quantising to four bits."""
    v = _vectors(spark, folder).select("vec_id", arrays.doubles(_E).alias("x"), arrays.quantize(_E, 32, 4).alias("q"), arrays.scales(_E, 32, 4).alias("s"))
    return v.select("vec_id", "x", "q", "s", arrays.dequantize(F.col("q"), F.col("s"), 32).alias("y"))


@query("golden_difference", f"SELECT vec_id, round(max(abs(x - y)), 6) AS worst, round(sqrt(avg((x - y) * (x - y))), 6) AS rms, arg_max(pos, (x, -pos)) = arg_max(pos, (y, -pos)) AS same_best, max(abs(x - y)) < 0.02 AS pass FROM {_BACK} GROUP BY vec_id")
def golden_difference(spark, folder):
    """Largest and root mean square difference, same first maximum, verdict."""
    b = _back(spark, folder).withColumn("d", F.zip_with("x", "y", lambda a, z: a - z))
    first = lambda name: F.array_position(F.col(name), F.array_max(name))
    worst = F.array_max(F.transform("d", F.abs))
    return b.select("vec_id", F.round(worst, 6).alias("worst"), F.round(F.sqrt(arrays.dot(F.col("d"), F.col("d")) / F.size("d")), 6).alias("rms"), (first("x") == first("y")).alias("same_best"), (worst < 0.02).alias("pass"))


@query("tolerant_difference", f"SELECT vec_id, count(*) FILTER (WHERE pos % 7 = vec_id % 7)::INT AS missing, round(max(abs(x - y)) FILTER (WHERE pos % 7 <> vec_id % 7), 6) AS worst, arg_max(pos, (x, -pos)) FILTER (WHERE pos % 7 <> vec_id % 7) = arg_max(pos, (y, -pos)) FILTER (WHERE pos % 7 <> vec_id % 7) AS top_match FROM {_BACK} GROUP BY vec_id")
def tolerant_difference(spark, folder):
    """NaN values are counted and left out of the comparison."""
    holed = _back(spark, folder).withColumn("y", F.transform("y", lambda v, i: F.when(i % 7 == F.col("vec_id") % 7, F.lit(float("nan"))).otherwise(v)))
    both = holed.select("vec_id", F.filter(F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~F.isnan(p["b"])).alias("p"), F.size(F.filter("y", F.isnan)).alias("missing"))
    side = lambda k: F.transform("p", lambda p: p[k])
    first = lambda k: F.array_position(side(k), F.array_max(side(k)))
    return both.select("vec_id", "missing", F.round(F.array_max(F.transform("p", lambda p: F.abs(p["a"] - p["b"]))), 6).alias("worst"), (first("a") == first("b")).alias("top_match"))


_FIRST = "string_split(substr(question, 1, 30), '')"


@query("evidence_share", f"SELECT id, round(len(list_filter({_FIRST}, lambda ch: contains(answer, ch)))::DOUBLE / len({_FIRST}), 6) AS share FROM {c._KB}")
def evidence_share(spark, folder):
    """Share of the first thirty tokens that come back in a text."""
    first = F.split(F.substring("question", 1, 30), "")
    return c.kb(spark, folder).select("id", F.round(F.size(F.filter(first, lambda ch: F.contains(F.col("answer"), ch))) / F.size(first), 6).alias("share"))


_PLANS = [(f"plan{k}", v, d, n, p, h) for k, (v, d, n, p, h) in enumerate([(4096, 96, 6, 32, 256), (8192, 128, 6, 48, 384), (8196, 128, 8, 64, 512), (32768, 192, 8, 64, 768), (1000, 64, 2, 16, 128)])]
_PLANS_SQL = "(VALUES " + ", ".join(str(r) for r in _PLANS) + ") t(plan, vocab, d, layers, ple, ffn)"
# Bytes of memory and of flash, bytes a second read from flash.
SRAM, FLASH, BANDWIDTH = 512 * 1024, 16 * 1024 * 1024, 60_000_000


def _plans(spark):
    return spark.createDataFrame(_PLANS, "plan string, vocab long, d long, layers long, ple long, ffn long")


@query(
    "parameter_budget",
    f"""SELECT plan, core, stream, tab, core + stream + tab AS total, core * 0.5 <= {SRAM} AS fits, tab * 0.5 <= {FLASH} AS fits_flash, round(1.0 / ((stream * 0.5 + layers * ple * 0.5) / {BANDWIDTH}), 3) AS ceiling FROM (
    SELECT plan, layers, ple, layers * (4 * d * d + 3 * d * ffn + 2 * d * ple) + d * layers * ple AS core, vocab * d AS stream, vocab * layers * ple AS tab FROM {_PLANS_SQL})""",
)
def parameter_budget(spark, folder):
    """Parameters of each tier at four bits, what fits, tokens a second that the bandwidth allows."""
    t = _plans(spark).selectExpr("plan", "layers", "ple", "layers * (4 * d * d + 3 * d * ffn + 2 * d * ple) + d * layers * ple AS core", "vocab * d AS stream", "vocab * layers * ple AS tab")
    half = lambda x: F.col(x) * 0.5
    seconds = (half("stream") + F.col("layers") * F.col("ple") * 0.5) / BANDWIDTH
    return t.select("plan", "core", "stream", "tab", F.expr("core + stream + tab").alias("total"), (half("core") <= SRAM).alias("fits"), (half("tab") <= FLASH).alias("fits_flash"), F.round(1.0 / seconds, 3).alias("ceiling"))


@query("widest_layer", f"SELECT plan, max(h) AS ffn FROM (SELECT plan, d, layers, ple, unnest(range(1, 4097)) AS h FROM {_PLANS_SQL}) WHERE layers * (4 * d * d + 3 * d * h + 2 * d * ple) + d * layers * ple <= 1000000 GROUP BY plan")
def widest_layer(spark, folder):
    """The widest hidden layer within a core budget."""
    each = _plans(spark).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(4096))))
    return each.where("layers * (4 * d * d + 3 * d * h + 2 * d * ple) + d * layers * ple <= 1000000").groupBy("plan").agg(F.max("h").cast("long").alias("ffn"))


@query("throughput", "SELECT user_id, count(*) AS tokens, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 6) AS per_second FROM events GROUP BY user_id")
def throughput(spark, folder):
    """Tokens a second of each stream."""
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return table(spark, folder, "events", ["user_id", "ts"]).groupBy("user_id").agg(F.count("*").alias("tokens"), F.round(F.count("*") / F.greatest(span, F.lit(1.0)), 6).alias("per_second"))


# ---------------------------------------------------------------- kernels


@query("matvec", f"SELECT b.vec_id, round(sum(b.y * c.x), 5) AS product FROM {_BACK} b JOIN (SELECT pos, x FROM {_CELLS} WHERE vec_id = 0) c ON c.pos = b.pos GROUP BY b.vec_id")
def matvec(spark, folder):
    """Quantised rows times a vector."""
    x = [float(v) for v in _vectors(spark, folder).where("vec_id = 0").select(arrays.doubles(_E)).first()[0]]
    return _back(spark, folder).select("vec_id", F.round(arrays.matvec_row(F.col("q"), F.col("s"), F.array(*[F.lit(v) for v in x]), 32), 5).alias("product"))


@query("activation_codes", f"SELECT vec_id, pos::INT AS pos, greatest(least(round_even(x / s, 0), 127), -127)::INT AS code FROM (SELECT *, greatest(max(abs(x)) OVER (PARTITION BY vec_id) / 127.0::DOUBLE, 1e-8) AS s FROM {_CELLS})")
def activation_codes(spark, folder):
    """One scale for the whole vector."""
    return _vectors(spark, folder).select("vec_id", F.posexplode(arrays.quantize(_E, 1 << 20, 8)).alias("pos", "code"))


_NAMES = ("attn.qkv.weight", "ffn.up.weight", "ple_gate.0", "ple_table", "head.weight", "ple_model_proj", "norm.w", "x.ple_proj.y")


@query("precision_by_name", "SELECT name, CASE WHEN contains(name, 'attn.') OR contains(name, 'ffn.') OR contains(name, 'ple_gate') OR contains(name, 'ple_proj') OR contains(name, 'ple_model_proj') THEN 8 ELSE 4 END AS bits FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") t(name)")
def precision_by_name(spark, folder):
    """Eight bits for core tensors, four for the others."""
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return names.select("name", F.when(F.col("name").rlike(r"attn\.|ffn\.|ple_gate|ple_proj|ple_model_proj"), 8).otherwise(4).alias("bits"))


@query("normalised", f"SELECT vec_id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id) / count(*) OVER (PARTITION BY vec_id) + 1e-6), 6) AS v FROM {_CELLS}")
def normalised(spark, folder):
    """Every element by the root mean square."""
    return _vectors(spark, folder).select("vec_id", F.posexplode(arrays.rms_norm(_E)).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


@query("gated", f"SELECT vec_id, pos::INT AS pos, round(x / (1 + exp(-x)), 6) AS v FROM {_CELLS}")
def gated(spark, folder):
    """Silu."""
    return _vectors(spark, folder).select("vec_id", F.posexplode(F.transform(arrays.doubles(_E), arrays.silu)).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


_ANGLE = "((a.vec_id % 17) / pow(10000.0::DOUBLE, a.pos / 32.0::DOUBLE))"


@query("rotated", f"SELECT a.vec_id, a.pos::INT AS pos, round(a.x * cos{_ANGLE} - b.x * sin{_ANGLE}, 5) AS lo, round(a.x * sin{_ANGLE} + b.x * cos{_ANGLE}, 5) AS hi FROM {_CELLS} a JOIN {_CELLS} b ON b.vec_id = a.vec_id AND b.pos = a.pos + 32 WHERE a.pos < 32")
def rotated(spark, folder):
    """Split halves turned by the position's angles."""
    r = _vectors(spark, folder).select("vec_id", arrays.rotate(_E, F.col("vec_id") % 17).alias("r"))
    halves = r.select("vec_id", F.posexplode(F.arrays_zip(F.slice("r", 1, 32).alias("lo"), F.slice("r", 33, 32).alias("hi"))).alias("pos", "z"))
    return halves.select("vec_id", "pos", F.round("z.lo", 5).alias("lo"), F.round("z.hi", 5).alias("hi"))


@query("finite_values", f"SELECT vec_id, pos::INT AS pos, round(CASE WHEN pos % 5 = 1 THEN 0 ELSE x END, 6) AS v FROM {_CELLS}")
def finite_values(spark, folder):
    """F16: NaN and infinities become 0."""
    broken = F.transform(arrays.doubles(_E), lambda x, i: F.when(i % 10 == 1, F.lit(float("nan"))).when(i % 10 == 6, F.lit(float("-inf"))).otherwise(x))
    return _vectors(spark, folder).select("vec_id", F.posexplode(arrays.finite(broken)).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


_LOGITS = f"(SELECT vec_id, pos, x / 0.7 / CASE WHEN pos IN (vec_id % 64, (vec_id + 3) % 64) THEN 1.3 ELSE 1 END AS x FROM {_CELLS})"
_PROBS = f"(SELECT vec_id, pos, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM {_LOGITS}) WHERE r <= 20 WINDOW w AS (PARTITION BY vec_id))"


@query("sampled_tokens", f"SELECT vec_id, coalesce(min(pos) FILTER (WHERE total > draw), max(pos))::INT AS token FROM (SELECT vec_id, pos, (vec_id * 7919 % 1000) / 1000.0::DOUBLE + 0.00037 AS draw, sum(p) OVER (PARTITION BY vec_id ORDER BY pos) AS total FROM {_PROBS}) GROUP BY vec_id")
def sampled_tokens(spark, folder):
    """Temperature, penalty for tokens seen, the top twenty with ties, softmax, the running sum that passes the draw."""
    seen = F.array((F.col("vec_id") % 64).cast("int"), ((F.col("vec_id") + 3) % 64).cast("int"))
    scaled = _vectors(spark, folder).select("vec_id", arrays.penalised(F.transform(arrays.doubles(_E), lambda x: x / 0.7), seen, 1.3).alias("x"))
    floored = scaled.select("vec_id", "x", F.array_min(arrays.top_k_kept(F.col("x"), 20)).alias("floor"))
    kept = floored.select("vec_id", F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda t: t["v"] >= F.col("floor")).alias("t"))
    draw = (F.col("vec_id") * 7919 % 1000) / 1000.0 + 0.00037
    at = arrays.sampled(arrays.softmax(F.transform("t", lambda t: t["v"])), draw)
    return kept.select("vec_id", F.element_at(F.col("t"), at + 1)["i"].alias("token"))


def _shift_sql(x: str, op: str, n: int) -> str:
    return f"xor({x}, ({x} {op} {n}) & 4294967295)"


_X1 = f"(SELECT event_id, {_shift_sql('(event_id + 1)', '<<', 13)} AS x FROM events)"
_X2 = f"(SELECT event_id, {_shift_sql('x', '>>', 17)} AS x FROM {_X1})"


@query("random_steps", f"SELECT event_id, {_shift_sql('x', '<<', 5)}::BIGINT AS x FROM {_X2}")
def random_steps(spark, folder):
    """One step of the generator from each seed, as an unsigned number."""
    x = arrays.xorshift((F.col("event_id") + 1).cast("int"))
    return table(spark, folder, "events", ["event_id"]).select("event_id", x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x"))


@query("learning_rates", "SELECT step::BIGINT AS step, round(CASE WHEN step < 100 THEN 0.003 * (step + 1) / 100 ELSE 0.003 * (0.1 + 0.45 * (1 + cos(pi() * (step - 100) / 900.0))) END, 9) AS rate FROM range(1001) t(step)")
def learning_rates(spark, folder):
    """Warm-up, then a cosine down to a tenth."""
    return spark.range(1001).select(F.col("id").alias("step"), F.round(arrays.learning_rate(F.col("id"), 100, 1000, 0.003), 9).alias("rate"))


@query("widened_rows")
def widened_rows(spark, folder):
    """Rows of small random numbers behind the present ones; random, so without a twin in SQL."""
    v = _vectors(spark, folder).select("vec_id", arrays.doubles(_E).alias("w"))
    n = v.agg(F.coalesce(F.max("vec_id"), F.lit(-1))).first()[0]
    new = spark.range(n + 1, n + 4).select(F.col("id").alias("vec_id"), F.array(*[F.randn(k) * 0.02 for k in range(64)]).alias("w"))
    return v.unionByName(new)


@query("half_precision")
def half_precision(spark, folder):
    """Values rounded to IEEE halves and back, in Arrow batches; tested against numpy."""
    return arrays.as_halves(_vectors(spark, folder).select("vec_id", arrays.doubles(_E).alias("v")), "vec_id", "v")


@query("joined_rows", "SELECT vec_id, len(embedding) * 3 AS n, round(embedding[1]::DOUBLE, 6) AS q, round(embedding[2]::DOUBLE, 6) AS k FROM embeddings")
def joined_rows(spark, folder):
    """Three row blocks as one; parameters counted."""
    three = _vectors(spark, folder).select("vec_id", F.concat(_E, F.reverse(_E), _E).alias("w"), F.size(_E).alias("n"))
    return three.select("vec_id", F.size("w").cast("long").alias("n"), F.round(F.element_at("w", 1).cast("double"), 6).alias("q"), F.round(F.element_at(F.col("w"), 2 * F.col("n") + 2).cast("double"), 6).alias("k"))


# ---------------------------------------------------------------- sets and order


@query("lowest_code_points", "SELECT ch, unicode(ch)::INT AS cp FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0) WHERE unicode(ch) > 32 ORDER BY cp LIMIT 300")
def lowest_code_points(spark, folder):
    """A font's share of the characters, lowest code points first."""
    ch = c.docs(spark, folder).where(F.length("text") > 0).select(F.explode(F.split("text", "")).alias("ch")).distinct()
    cp = F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("int")
    return ch.select("ch", cp.alias("cp")).where("cp > 32").orderBy("cp").limit(300)


@query("character_union", f"SELECT DISTINCT ch FROM (SELECT unnest(string_split(term, '')) AS ch FROM term_dict WHERE term <> '' UNION ALL SELECT token FROM ({c._VOCAB}))")
def character_union(spark, folder):
    """Characters of two sets, each once."""
    t = table(spark, folder, "term_dict", ["term"]).where("term <> ''").select(F.explode(F.split("term", "")).alias("ch"))
    return t.unionByName(c.vocabulary(spark, folder).select(F.col("token").alias("ch"))).distinct()


@query("font_coverage", f"SELECT round(avg(CASE WHEN v.token IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, count(*) AS characters FROM (SELECT DISTINCT unnest(string_split(answer, '')) AS ch FROM {c._KB}) t LEFT JOIN ({c._VOCAB}) v ON v.token = t.ch")
def font_coverage(spark, folder):
    """Share of the characters that are covered."""
    ch = c.kb(spark, folder).select(F.explode(F.split("answer", "")).alias("token")).distinct()
    hit = ch.join(F.broadcast(c.vocabulary(spark, folder).select("token", F.lit(1.0).alias("hit"))), "token", "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("coverage"), F.count("*").alias("characters"))


@query("first_of_kind", "SELECT qa_id, list_filter([question, answer], lambda x: length(x) > 12)[1] AS first FROM (SELECT DISTINCT qa_id, question, answer FROM deepseek_qa)")
def first_of_kind(spark, folder):
    """The first of several texts that will do."""
    p = table(spark, folder, "deepseek_qa", ["qa_id", "question", "answer"]).dropDuplicates(["qa_id"])
    return p.select("qa_id", F.try_element_at(F.filter(F.array("question", "answer"), lambda x: F.length(x) > 12), F.lit(1)).alias("first"))


@query("corpus_layout", "SELECT doc_id, (sum(octet_length(encode(text)) + 2) OVER (ORDER BY doc_id) - octet_length(encode(text)) - 2)::BIGINT AS first_byte FROM documents WHERE length(text) > 0")
def corpus_layout(spark, folder):
    """Where each text begins in a corpus of texts with a blank line between them."""
    d = c.docs(spark, folder).where(F.length("text") > 0).select("doc_id", (F.octet_length("text") + 2).alias("size"))
    return order.running_before(d, [F.col("doc_id")], F.col("size"), "first_byte").select("doc_id", "first_byte")


@query("largest_first", "SELECT question, max(id) AS id FROM format_data WHERE question IS NOT NULL GROUP BY question ORDER BY md5(question || '|9'), question LIMIT 200")
def largest_first(spark, folder):
    """One record a question in seeded order, up to a maximum."""
    q = table(spark, folder, "format_data", ["id", "question"]).where("question is not null").groupBy("question").agg(F.max("id").alias("id"))
    return q.orderBy(order.hash_order(F.col("question"), 9), "question").limit(200)


@query("stream_windows", "SELECT query_id, first, substr(text, first + 1, 8) AS x, substr(text, first + 2, 8) AS y FROM (SELECT query_id, text, (query_id * 31 % (length(text) - 8))::INT AS first FROM retrieval_query WHERE length(text) > 8)")
def stream_windows(spark, folder):
    """A window of the token stream and the same one step on."""
    q = c._q_table(spark, folder).where(F.length("text") > 8).withColumn("first", F.expr("cast(query_id * 31 % (length(text) - 8) as int)"))
    return q.select("query_id", "first", F.expr("substring(text, first + 1, 8)").alias("x"), F.expr("substring(text, first + 2, 8)").alias("y"))


@query("index_health", f"SELECT (SELECT count(DISTINCT id) FROM {c._KB}) AS docs, count(*) AS terms, count(*) <= 20000 AS within, sum(df)::BIGINT AS postings FROM {c._IDF}")
def index_health(spark, folder):
    """Sizes of an index and whether they keep to its bounds."""
    k, post, n = c._index(spark, folder)
    from quern.operators import search

    t = search.idf(post, n)
    return t.agg(F.lit(n).cast("long").alias("docs"), F.count("*").alias("terms"), (F.count("*") <= 20000).alias("within"), F.sum("df").alias("postings"))


@query("requests", "SELECT event_id, least((props::JSON ->> '$.k')::BIGINT, 50) AS most, len(list_filter([(props::JSON ->> '$.k')::BIGINT, event_id % 9], lambda x: x < 60))::INT AS ids FROM events WHERE props IS NOT NULL")
def requests(spark, folder):
    """A request line with ids and a maximum, both bounded."""
    e = table(spark, folder, "events", ["event_id", "props"]).where("props is not null").withColumn("k", F.get_json_object("props", "$.k"))
    line = F.concat(F.lit('{"ids":['), "k", F.lit(","), (F.col("event_id") % 9).cast("string"), F.lit('],"max":'), "k", F.lit("}"))
    r = e.select("event_id", F.from_json(line, "ids ARRAY<BIGINT>, max BIGINT").alias("r"))
    return r.select("event_id", F.least("r.max", F.lit(50).cast("long")).alias("most"), F.size(F.filter("r.ids", lambda x: x < 60)).alias("ids"))
