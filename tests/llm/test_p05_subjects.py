import numpy as np

from quern.llm import p05_subjects as p

AREAS = [("sea", "海", "sea", "潮汐、船锚; tide table"), ("sky", "天", "sky", "云层、风筝; wind sock")]
TERMS = ["潮汐", "船锚", "灯塔", "云层", "风筝", "滑翔", "的", "第1", None, "harbour light", "tide table"]
SCHEMA = "id long, label string, question string, answer string, subject string"


def test_terms_and_sentences():
    lex = p.Lexicon(AREAS, [t for t in TERMS if t])
    names = [[lex.terms[t] for t in s] for s in p.sentence_terms("看潮汐和船锚。没有。HARBOUR light on; harbour lights\n灯塔", lex)]
    assert names == [["潮汐", "船锚"], ["harbour light"], ["灯塔"]]
    long = "潮汐" + "一二三四五六七八九十" * 5 + "船锚" + "一二三四五六七八九十" * 5 + "灯塔"
    assert len(p.sentence_terms(long, lex)) == 3
    assert p.sentence_terms("", lex) == [] and p.Lexicon([], []).hits("x") == []


def at(*votes):
    return p._pattern(votes)


def test_accuracies_from_agreement():
    patterns = np.zeros(int(np.prod(p.SHAPE)))
    for votes, n in (((3, 0, 1, 2, 1), 1650), ((2, 0, 1, 2, 1), 430), ((2, 0, 0, 0, 1), 130), ((3, 0, 1, 1, 0), 280), ((2, 0, 0, 1, 0), 145), ((3, 0, 0, 0, 0), 20), ((1, 0, 0, 1, 0), 190), ((1, 0, 0, 0, 0), 32)):
        patterns[at(*votes)] = n
    post = p.learn_accuracies(patterns)
    # a lexicon that the others confirm is believed alone, even against the label; single sentences aren't
    assert min(post[at(2, 0, 0, 1, 0)], post[at(3, 0, 0, 0, 0)]) > 0.5 > max(post[at(1, 0, 0, 1, 0)], post[at(1, 0, 0, 0, 0)])


def test_model_overrules_the_sentence_count():
    patterns = np.zeros(int(np.prod(p.SHAPE)))
    # the lexicon's pairs of sentences mostly stand against the label and without question or seed: a term of many meanings
    for votes, n in (((3, 0, 1, 2, 1), 300), ((2, 0, 1, 2, 1), 40), ((2, 0, 0, 1, 0), 900), ((1, 0, 0, 1, 0), 300), ((1, 0, 1, 2, 1), 30)):
        patterns[at(*votes)] = n
    post = p.learn_accuracies(patterns)
    assert post[at(2, 0, 0, 1, 0)] < 0.5 < post[at(2, 0, 1, 2, 1)]


def test_subjects(spark):
    rows = [(k, "港务", "潮汐？", "先看潮汐与灯塔。再看船锚和灯塔。", "c") for k in range(30)]
    rows += [(100 + k, "气象", "云层？", "先看云层与滑翔。再看风筝和滑翔。", "c") for k in range(30)]
    rows += [(200, None, None, "滑翔一次。", None), (201, "港务", "", "灯塔。灯塔。云层。", None), (202, "x", "", None, None), (203, "x", "", "", None), (204, "港务", "", "灯塔好。滑翔好。灯塔好。滑翔好。", None), (3, *rows[3][1:]), (205, "x", "q", "字" * 200000, None), (None, "x", "q", "灯塔。灯塔。", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    areas = spark.createDataFrame(AREAS, "subject string, name_zh string, name_en string, about string")
    terms = spark.createDataFrame([(t, "1", None) for t in TERMS], "term string, freq string, pos string")
    got = {(r.id, r.subject) for r in p.subjects(df, areas, terms).collect()}
    assert got == {(k, "sea") for k in range(30)} | {(100 + k, "sky") for k in range(30)} | {(201, "sea"), (204, "sea"), (204, "sky"), (None, "sea")}
    assert p.subjects(df.limit(0), areas, terms).count() == 0 and p.subjects(df, areas.limit(0), terms).count() == 0


def test_checked_sample_is_held_out(spark, data):
    from quern.sources.tables import table

    found = {(r.id, r.subject) for r in p.p5_found(spark, data).collect()}
    checked = {(r.id, r.subject) for r in table(spark, data, "subject_label").collect()}
    ids = {i for i, _ in checked}
    mine = {f for f in found if f[0] in ids}
    assert len(mine & checked) >= 0.9 * len(checked) and len(mine - checked) <= 0.1 * len(checked)
