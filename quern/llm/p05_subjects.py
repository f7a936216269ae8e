"""Problem 5: subject area of each document.

Labelling functions vote on (record, subject): the lexicon grown from the user dictionary,
its doubtful terms, the seed lexicon of the subject table, the record's label as its
address in the knowledge base, and the question as the record's opening section. The grown
lexicon comes from counts over all records: which terms share sentences, which share
labels, weighed by how well each kind of evidence agrees with the seeds. A latent model of
"subject present" learns the accuracy of every function by expectation maximisation over
the counts of vote patterns, from the agreement of the functions alone; no checked record
takes part. Records get the subjects whose posterior is at least `POSTERIOR`; an exact
check asks that at least `SENTENCES` sentences of the answer hold a term of the subject.

Null and empty answers and answers without any term have no subject. Copies of a record
count once. Records that are defective pairs (problem 2) are left out by `p5_found`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import p02_pairs
from quern.session import cut_lineage
from quern.sources.tables import table

POSTERIOR, SENTENCES = 0.5, 2
#: Buckets for labels; belief from which a term counts as a firm one of its subject, and as a doubtful one.
LABELS, FIRM, DOUBTFUL = 1 << 10, 0.6, 0.3
_SPLIT = re.compile(r"[。！？!?\n]+|(?<=[a-z0-9)])\.(?=\s|$)")
_SEPARATORS = re.compile(r"[、，,；;/]|\s-\s")


def normalised(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def _hash(text: str) -> int:
    h = 1469598103934665603
    for b in text.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def label_bucket(label: str | None) -> int:
    return 0 if label is None or not label.strip() else 1 + _hash(normalised(label).strip()) % (LABELS - 1)


class Lexicon:
    """Dictionary terms and, for seeds, their subjects."""

    def __init__(self, subjects: list[tuple], terms: list[str]):
        self.subjects = [r[0] for r in subjects]
        seeds: dict[str, int] = {}
        for k, (_, zh, en, about) in enumerate(subjects):
            parts = [t for field in (about or "").split(";") for t in _SEPARATORS.split(field)]
            for t in [*parts, zh or "", en or ""]:
                t = normalised(t).strip()
                if len(t) >= 2 and not t.isdigit():
                    seeds[t] = k if seeds.get(t, k) == k else -1
        known = dict.fromkeys(seeds)
        for t in terms:
            t = normalised(t or "").strip()
            if len(t) >= 2 and not any(c.isdigit() for c in t):
                known[t] = None
        self.terms = list(known)
        self.seed = np.array([seeds.get(t, -1) for t in self.terms], dtype=np.int64)
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, t in enumerate(self.terms):
                a.add_word(t, (k, len(t), t[0].isascii() and t[0].isalpha()))
            if len(self.terms):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(position, term) of the leftmost longest matches; terms in Latin letters match whole words."""
        if not self.terms or not text:
            return []
        out = []
        for end, (k, n, latin) in self.automaton().iter_long(text):
            start = end - n + 1
            if latin and (start and text[start - 1].isalnum() or end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalpha()):
                continue
            out.append((start, k))
        return out


#: A stretch without stops longer than RUN holds several sentences; there a term that lies
#: UNIT or more behind the first one of its sentence begins the next. For Han text and for others.
RUN, UNIT = (80, 220), (32, 85)


def sentence_terms(answer: str, lexicon: Lexicon) -> list[list[int]]:
    """Terms of each sentence that has any, stops missing or not."""
    text = normalised(answer)
    hits = lexicon.hits(text)
    if not hits:
        return []
    out: list[list[int]] = []
    stops = [m.start() for m in _SPLIT.finditer(text)] + [len(text)]
    at, last, begin, start = 0, -1, 0, 0
    for position, term in hits:
        while stops[at] < position:
            begin = stops[at]
            at += 1
        kind = int(text[position] < "\u2e80")
        if at != last or stops[at] - begin > RUN[kind] and position - start >= UNIT[kind]:
            out.append([])
            last, start = at, position
        out[-1].append(term)
    return out


def _count_terms(lexicon):
    """(code, n): pairs of terms a < b that share a sentence as a * terms + b, terms beside label buckets beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        n, held = len(lex.terms), []

        def flush():
            codes, count = np.unique(np.array(held, dtype=np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(count, pa.int64())], ["code", "n"])

        for batch in batches:
            for label, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not answer:
                    continue
                bucket = n * n + label_bucket(label)
                for terms in sentence_terms(answer, lex):
                    own = sorted(set(terms))
                    held += [bucket + a * LABELS for a in own]
                    held += [a * n + b for i, a in enumerate(own) for b in own[i + 1 :]]
            if len(held) > 2_000_000:
                yield flush()
        yield flush()

    return run


class Counts:
    """Sparse counts of terms that share a sentence (both ways) and of terms beside label buckets."""

    def __init__(self, n: int, codes: np.ndarray, counts: np.ndarray):
        codes, counts = np.asarray(codes, dtype=np.int64), np.asarray(counts, dtype=np.float64)
        pair = codes < n * n
        a, b, w = codes[pair] // n, codes[pair] % n, counts[pair]
        self.n = n
        self.a, self.b, self.w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
        rest = codes[~pair] - n * n
        self.term, self.bucket, self.k = rest // LABELS, rest % LABELS, counts[~pair]

    def company(self, x: np.ndarray) -> np.ndarray:
        """Sums of the rows of x over the mates of each term."""
        return np.stack([np.bincount(self.a, weights=self.w * c[self.b], minlength=self.n) for c in x.T], axis=1).astype(np.float64)

    def by_label(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.bucket, weights=self.k * c[self.term], minlength=LABELS) for c in x.T], axis=1).astype(np.float64)

    def from_label(self, x: np.ndarray) -> np.ndarray:
        known = self.bucket > 0
        return np.stack([np.bincount(self.term[known], weights=self.k[known] * c[self.bucket[known]], minlength=self.n) for c in x.T], axis=1).astype(np.float64)

    def mates(self) -> np.ndarray:
        return np.bincount(self.a, weights=self.w, minlength=self.n)

    def labelled(self) -> np.ndarray:
        known = self.bucket > 0
        return np.bincount(self.term[known], weights=self.k[known], minlength=self.n)


def grow(lexicon: Lexicon, counts: Counts, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Subject of every term, -1 where the evidence is too thin, and whether the term is a firm one.

    Belief spreads from the seeds along shared sentences and shared labels. Each round
    weighs the two kinds of evidence by the log odds of their agreement with the seeds,
    which are left out of their own vote. A term whose belief is low or whose mates belong
    to other subjects is a doubtful one.
    """
    n, m = len(lexicon.terms), len(lexicon.subjects)
    seed = lexicon.seed
    fixed = np.zeros((n, m))
    at = np.flatnonzero(seed >= 0)
    fixed[at, seed[at]] = 1
    belief = fixed.copy()
    alone = (counts.mates() + counts.labelled() == 0) & (seed < 0)
    for _ in range(rounds):
        by_label = counts.by_label(belief)
        by_label /= np.maximum(by_label.sum(axis=1, keepdims=True), 1e-9)
        votes = []
        for v in (counts.company(belief), counts.from_label(by_label)):
            total = v.sum(axis=1, keepdims=True)
            p = (v + 0.5 / m) / (total + 0.5)
            judged = at[total[at, 0] >= 3]
            right = (p[judged].argmax(axis=1) == seed[judged]).mean() if len(judged) else 0.5
            right = min(max((right * len(judged) + 1) / (len(judged) + 2), 0.2), 0.98)
            weight = np.log(right / (1 - right) * max(1, m - 1))
            votes.append(weight * np.log(p) * (total > 0))
        score = sum(votes)
        score -= score.max(axis=1, keepdims=True)
        new = np.exp(score)
        new /= new.sum(axis=1, keepdims=True)
        new[at] = fixed[at]
        new[alone] = 0
        moved, belief = np.abs(new - belief).max(initial=0.0), new
        if moved < 1e-4:
            break
    best = belief.argmax(axis=1) if m else np.zeros(n, dtype=np.int64)
    top = belief.max(axis=1, initial=0.0)
    out = np.where(top >= FIRM, best, -1)
    same = np.bincount(counts.a, weights=counts.w * (out[counts.a] == out[counts.b]) * (out[counts.a] >= 0), minlength=n) / np.maximum(1.0, counts.mates())
    firm = (out >= 0) & ~((seed < 0) & (counts.mates() > 0) & (same < 0.5))
    return np.where(top >= DOUBTFUL, best, -1), firm


def label_subjects(lexicon: Lexicon, counts: Counts, subject: np.ndarray) -> np.ndarray:
    """The subject a label bucket stands for, -1 where none holds half of its terms; `subject` names the firm terms'."""
    by = counts.by_label(np.stack([(subject == s).astype(float) for s in range(len(lexicon.subjects))], axis=1))
    total = by.sum(axis=1)
    out = np.where((total >= 5) & (by.max(axis=1) >= 0.5 * total), by.argmax(axis=1), -1)
    out[0] = -1
    return out


# Vote values by function: sentences with firm terms of the lexicon (0, 1, 2, 3 and more), further
# sentences with doubtful terms only (0, 1, 2 and more), sentences of the seeds (0, 1, 2 and more),
# label (0 silent, 1 other, 2 this one), question (0, 1). A function whose silence says nothing abstains at 0.
SHAPE, ABSTAINS = (4, 3, 3, 3, 2), (False, True, True, True, True)


def _pattern(votes: tuple[int, ...]) -> int:
    out = 0
    for v, k in zip(votes, SHAPE):
        out = out * k + v
    return out


def _vote(lexicon, subject, firm, by_label):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, of, sure, labels = lexicon.value, subject.value.tolist(), firm.value.tolist(), by_label.value.tolist()
        seeds = lex.seed.tolist()
        for batch in batches:
            out = []
            for key, label, question, answer in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not answer:
                    continue
                held: dict[int, list[int]] = {}  # subject -> firm, doubtful and seed sentences
                for terms in sentence_terms(answer, lex):
                    strong = {of[t] for t in terms if sure[t]}
                    for s in strong:
                        held.setdefault(s, [0, 0, 0])[0] += 1
                    for s in {of[t] for t in terms if of[t] >= 0} - strong:
                        held.setdefault(s, [0, 0, 0])[1] += 1
                    for s in {seeds[t] for t in terms if seeds[t] >= 0}:
                        held.setdefault(s, [0, 0, 0])[2] += 1
                if not held:
                    continue
                said = labels[label_bucket(label)]
                asked = {of[t] for _, t in lex.hits(normalised(question)) if sure[t]} if question else ()
                for s, (a, b, c) in held.items():
                    out.append((key, s, a + b, _pattern((min(a, 3), min(b, 2), min(c, 2), 0 if said < 0 else 1 + (said == s), int(s in asked)))))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], ["id", "s", "sentences", "pattern"])

    return run


def learn_accuracies(patterns: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Posterior of "subject present" for each vote pattern, from the counts of the patterns alone.

    Starts where the functions' votes are simply added and alternates between the
    accuracies of the votes (how often each comes with and without the subject) and the
    posteriors. Abstentions carry no weight.
    """
    index = np.array(list(np.ndindex(*SHAPE)))
    votes = np.array([-1.0, -1.0, 1.0, 1.5])[index[:, 0]] + np.array([0.0, 0.0, 0.5])[index[:, 1]] + np.array([0.0, 0.0, 0.5])[index[:, 2]] + np.array([0.0, -0.5, 1.0])[index[:, 3]] + np.array([0.0, 1.0])[index[:, 4]]
    post = 1 / (1 + np.exp(-2 * votes))
    for _ in range(rounds):
        yes, no = patterns * post, patterns * (1 - post)
        prior = np.log((yes.sum() + 1) / (no.sum() + 1))
        logit = np.full(len(index), prior)
        for f, k in enumerate(SHAPE):
            for v in range(int(ABSTAINS[f]), k):
                at = index[:, f] == v
                # two votes more that agree with the whole, so that rare votes weigh little
                share = (yes.sum() + 1) / (yes.sum() + no.sum() + 2)
                logit[at] += np.log((yes[at].sum() + 2 * share) / (no[at].sum() + 2 * (1 - share))) - prior
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    return post


def subjects(records: DataFrame, areas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, subject, sentences, posterior) for `records(id, label, question, answer)`; the subject table and the user dictionary are read by the driver."""
    spark = records.sparkSession
    sc = spark.sparkContext
    area_rows = sorted((tuple(r) for r in areas.where("subject is not null").select("subject", "name_zh", "name_en", "about").distinct().collect()), key=str)
    terms = sorted(r[0] for r in dictionary.select("term").where("term is not null").distinct().collect())
    if not area_rows:
        return spark.createDataFrame([], "id long, subject string, sentences int, posterior double")
    lexicon = Lexicon(area_rows, terms)
    records = records.select(F.col("id").cast("long").alias("id"), "label", "question", "answer")
    sent = sc.broadcast(lexicon)
    counted = records.select("label", "answer").mapInArrow(_count_terms(sent), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = Counts(len(lexicon.terms), counted.column(0).to_numpy(), counted.column(1).to_numpy())
    of, firm = grow(lexicon, counts)
    by_label = label_subjects(lexicon, counts, np.where(firm, of, -1))
    votes = records.mapInArrow(_vote(sent, sc.broadcast(of), sc.broadcast(firm), sc.broadcast(by_label)), "id long, s int, sentences int, pattern int")
    votes = cut_lineage(votes.distinct())
    patterns = np.zeros(int(np.prod(SHAPE)))
    for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect():
        patterns[r.pattern] = r.n
    post = learn_accuracies(patterns)
    posterior = F.element_at(F.array(*[F.lit(float(p)) for p in post]), F.col("pattern") + 1)
    subject = F.element_at(F.array(*[F.lit(s) for s in lexicon.subjects]), F.col("s") + 1)
    out = votes.select("id", subject.alias("subject"), "sentences", posterior.alias("posterior"))
    return out.where((F.col("posterior") >= POSTERIOR) & (F.col("sentences") >= SENTENCES)).groupBy("id", "subject").agg(F.max("sentences").alias("sentences"), F.max("posterior").alias("posterior"))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "format_data", ["id", "label", "question", "answer"])
    return subjects(records, table(spark, folder, "subject_area"), table(spark, folder, "term_dict"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "format_data", ["id", "question", "answer"])
    defective = p02_pairs.pair_defects(pairs, p02_pairs.all_pairs(spark, folder)).select("id")
    return _assigned(spark, folder).join(defective, "id", "left_anti").select("id", "subject")


def p5_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Records by subject."""
    return p5_found(spark, folder).groupBy("subject").agg(F.count("*").alias("records"))


QUERIES = {"p5_found": p5_found, "p5_composition": p5_composition}
ORACLES: dict[str, str] = {}
