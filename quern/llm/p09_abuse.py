"""Problem 9: abusive, hateful or sexual content.

Texts are cut into sentences and brought to plain letters (NFKC, lower case, signs inside
words dropped, digits and signs that stand for letters read as letters, stretched letters
shortened). A sentence is known by its subsequences, three Han characters within five or
five other letters within six, each weighted by DECAY to its gaps: the gap-bounded
subsequence string kernel.
Subsequences common in harmless sentences weigh nothing. Landmarks are chosen among
passages of reviewed documents and scaled to unit length; the Nyström map (the kernel of a
sentence against them, whitened by the kernel among them) feeds a linear support vector
machine. Reviewed documents are labelled as a whole, so the sentences of an abusive one
are told apart by their evidence (log odds of runs of letters, counted without the
document itself) against that of harmless sentences, and then by the machine itself, over
a few rounds. The threshold's place between harmless and abusive sentences is chosen on
one half of the reviewed documents with a machine trained on the other.

A document's score is its highest sentence score; above 0 it is flagged. Null and empty
texts score `-inf`-like EMPTY and are never flagged. Without reviewed documents of both
kinds nothing is flagged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._stats import summed_table
from quern.llm._text import code_points, mix64
from quern.sources.tables import table

DECAY, EMPTY = 0.7, -10.0
HAN_OFFSETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
OTHER_OFFSETS = [(1, 2, 3, 4), (2, 3, 4, 5), (1, 3, 4, 5), (1, 2, 4, 5), (1, 2, 3, 5)]
TABLE_BITS = 20
#: Log odds from which a run of letters counts as evidence of abuse, and the share of harmless sentences whose evidence a witness must exceed.
EVIDENT, QUIET = 1.5, 0.998
#: Places between the highest harmless and the usual abusive sentence that are compared for the threshold, and what a share of false
#: alarms costs beside a share of misses: about as many harmless documents as there are to an abusive one.
OFFSETS, ALARM_COST = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5), 20.0
#: Reviewed documents used for training (lowest hashes first), landmarks, and sentences kept of harmless ones.
MAX_REVIEWED, LANDMARKS, MAX_HARMLESS = 4_000, 220, 6_000
# Signs and digits read as letters, beside Latin letters only.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "l", "€": "e"})
_DISGUISED = re.compile(r"[a-z0-9$@!|€]*(?:[a-z][013457$@|€]|[013457$@|€][a-z]|[a-z]![a-z])[a-z0-9$@!|€]*")
_QUANTITY = re.compile(r"^\d+[a-z]{1,3}$|^[a-z]{1,3}\d+$")
_ENDS = re.compile(r"[。！？…\n\r]+|[!?]+(?![\w$@])|(?<=[a-z\"')])\.(?=\s|$)|(?<=\d)\.(?=\s)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_STRETCHED = re.compile(r"(.)\1{2,}")
_DOUBLED_VOWEL = re.compile(r"aa|ii|uu")


def plain(flat: str) -> str:
    """Letters of lower-case text, disguises undone."""
    if _DISGUISED.search(flat):
        flat = _DISGUISED.sub(lambda m: m.group(0) if _QUANTITY.match(m.group(0)) else m.group(0).rstrip("!|").translate(STAND_INS), flat)
    out = _NOT_LETTER.sub("", flat)
    return _DOUBLED_VOWEL.sub(lambda m: m.group(0)[0], _STRETCHED.sub(r"\1", out))


def _flat(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def sentences(text: str | None) -> list[str]:
    """Plain letters of each sentence of a text."""
    if not text:
        return []
    return [s for part in _ENDS.split(_flat(text)) if part and len(part) > 3 and len(s := plain(part)) > 3]


def _positions(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = code_points("\x00".join(texts) + "\x00").astype(np.uint64)
    return points, np.cumsum(points == 0) - (points == 0)


def _patterns(points: np.ndarray):
    """For every offset pattern: the positions it starts at, its reach, the packed subsequences and their weight."""
    n = len(points)
    han, other = np.flatnonzero(points >= 0x2E80), np.flatnonzero((points > 0) & (points < 0x2E80))
    for offsets in HAN_OFFSETS:
        at = han[: np.searchsorted(han, n - offsets[-1])]
        yield at, offsets[-1], (points[at] << np.uint64(42)) | (points[at + offsets[0]] << np.uint64(21)) | points[at + offsets[1]], DECAY ** (offsets[-1] - 2)
    for offsets in OTHER_OFFSETS:
        at = other[: np.searchsorted(other, n - offsets[-1])]
        h = points[at]
        for o in offsets:
            h = (h << np.uint64(12)) ^ points[at + o]
        yield at, offsets[-1], h | np.uint64(1 << 63), DECAY ** (offsets[-1] - 4)


class Kernel:
    """Sparse kernel values against landmarks: a filter of bits, then sorted subsequences with their landmark weights."""

    FILTER = 22

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        points, owner = _positions(landmarks)
        o, g, w = [], [], []
        for at, reach, h, weight in _patterns(points):
            good = owner[at] == owner[at + reach]
            good &= points[at + reach] != 0
            o.append(owner[at[good]])
            g.append(h[good])
            w.append(np.full(int(good.sum()), weight))
        o, g, w = np.concatenate(o), np.concatenate(g), np.concatenate(w)
        order = np.lexsort((o, g))
        o, g, w = o[order], g[order], w[order]
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])]) if len(g) else np.zeros(0, dtype=int)
        w = np.add.reduceat(w, first) if len(first) else w
        o, g = o[first], g[first]
        self.own = np.maximum(np.bincount(o, weights=w * w, minlength=len(landmarks)), 1e-9)
        self.grams, start = np.unique(g, return_index=True)
        self.start = np.r_[start, len(g)]
        self.at, self.weight = o, w
        self.bits = np.zeros(1 << self.FILTER, dtype=bool)
        self.bits[self._slot(self.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.FILTER)).astype(np.int64)

    def without(self, harmless: list[str], most: float = 0.0005) -> Kernel:
        """The kernel with weight 0 for subsequences that occur in more than that share of harmless sentences."""
        seen = np.zeros(len(self.grams), dtype=np.int64)
        for a in range(0, len(harmless), 20_000):
            points, owner = _positions(harmless[a : a + 20_000])
            for at, reach, h, _ in _patterns(points):
                hit = self.bits[self._slot(h)]
                at, h = at[hit], h[hit]
                found = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
                seen += np.bincount(found[(self.grams[found] == h) & (owner[at] == owner[at + reach])], minlength=len(self.grams))
        keep = np.repeat(seen <= max(1.0, most * len(harmless)), np.diff(self.start))
        g = np.repeat(self.grams, np.diff(self.start))[keep]
        self.at, self.weight = self.at[keep], self.weight[keep]
        self.own = np.maximum(np.bincount(self.at, weights=self.weight**2, minlength=len(self.landmarks)), 0.5)
        self.grams, start = np.unique(g, return_index=True)
        self.start = np.r_[start, len(g)]
        self.bits[:] = False
        self.bits[self._slot(self.grams)] = True
        return self

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the texts that share a subsequence with a landmark, and their scaled kernel rows."""
        rows, cols, data = [], [], []
        if texts and len(self.grams):
            points, owner = _positions(texts)
            for at, reach, h, weight in _patterns(points):
                hit = self.bits[self._slot(h)]
                at, h = at[hit], h[hit]
                found = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
                good = (self.grams[found] == h) & (owner[at] == owner[at + reach]) & (points[at + reach] != 0)
                at, found = at[good], found[good]
                if len(at):
                    size = self.start[found + 1] - self.start[found]
                    spread = np.repeat(self.start[found] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
                    rows.append(np.repeat(owner[at], size))
                    cols.append(self.at[spread])
                    data.append(self.weight[spread] * weight)
        m = len(self.landmarks)
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros((0, m))
        r, c, d = np.concatenate(rows), np.concatenate(cols), np.concatenate(data)
        chosen, index = np.unique(r, return_inverse=True)
        out = np.bincount(index * m + c, weights=d, minlength=len(chosen) * m).reshape(len(chosen), m)
        return chosen, out / np.sqrt(self.own)


class Machine:
    """Kernel, Nyström map and weights."""

    def __init__(self, kernel: Kernel, whitening: np.ndarray, weights: np.ndarray, bias: float):
        self.kernel, self.whitening, self.weights, self.bias = kernel, whitening, weights, bias
        self.line = whitening @ weights
        self.span = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a in range(0, len(texts), 20_000):
            at, k = self.kernel.values(texts[a : a + 20_000])
            if len(at):
                out[a + at] = k @ self.line + self.bias
        return out


def _svm(x: np.ndarray, y: np.ndarray, c: float = 300.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by Newton steps; both classes weigh the same in total."""
    z = np.c_[x, np.ones(len(x))]
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c / 100
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        new = np.linalg.solve(ridge + (za * ca[:, None]).T @ za, (za * ca[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def _diverse(texts: list[str], most: int) -> list[str]:
    """Sentences that share least with those taken before, in a fixed order."""
    left, taken, have = sorted(set(texts), key=lambda t: (len(t) > 60, mix64(code_points(t[:40]).astype(np.uint64)).sum() % np.uint64(1 << 32))), [], set()
    left = left[: 8 * most]
    grams = {t: {t[k : k + 3] for k in range(len(t) - 2)} for t in left}
    for share in (0.3, 0.6, 0.9):
        for t in left:
            if len(taken) < most and t not in taken and len(grams[t] & have) <= share * len(grams[t]):
                taken.append(t)
                have |= grams[t]
    return taken


def _slots(texts: list[str], index: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, table slot) of the runs of letters of each text: three Han characters or six others; `index` gets their positions."""
    points, owner = _positions(texts)
    out_o, out_s = [], []
    for han, width in ((True, 3), (False, 6)):
        at = np.flatnonzero((points >= 0x2E80) == han)
        at = at[: np.searchsorted(at, len(points) - width + 1)]
        at = at[(owner[at] == owner[at + width - 1]) & (points[at + width - 1] != 0) & (points[at] != 0)]
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = h * np.uint64(0x100000001B3) + points[at + k]
        if index is not None:
            index.append(at)
        out_o.append(owner[at])
        out_s.append((mix64(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    return np.concatenate(out_o), np.concatenate(out_s)


def fill_runs(batch: pa.RecordBatch, counts: np.ndarray) -> None:
    """Adds the runs of letters of all texts, and their number in the last place."""
    texts = [plain(_flat(t)) for t in batch.column(0).to_pylist() if t]
    for a in range(0, len(texts), 2000):
        counts[:-1] += np.bincount(_slots(texts[a : a + 2000])[1], minlength=len(counts) - 1)
    counts[-1] += len(texts)


class Evidence:
    """Log odds of runs of letters: share of the abusive reviewed documents against the corpus and the harmless reviewed ones.

    The corpus holds abuse as well, so its share only bounds the odds from below. A document
    never speaks for itself: its own runs count without it.
    """

    def __init__(self, bad: list[list[str]], good: list[list[str]], counts: np.ndarray):
        self.bad, self.good = self._held(bad, len(counts) - 1), self._held(good, len(counts) - 1)
        self.n, self.m, self.counts, self.total = len(bad), len(good), counts[:-1], max(float(counts[-1]), len(bad) + 1.0)

    @staticmethod
    def _held(docs: list[list[str]], length: int) -> np.ndarray:
        out = np.zeros(length)
        for doc in docs:
            if doc:
                out[np.unique(_slots(doc)[1])] += 1
        return out

    def odds(self, slots: np.ndarray, own_bad: int = 0, own_good: int = 0) -> np.ndarray:
        a, h = self.bad[slots] - own_bad, self.good[slots] - own_good
        corpus = np.maximum(self.counts[slots] - self.bad[slots] - self.good[slots], 0.0) + 0.5
        rate = np.maximum(corpus / self.total, h / max(1, self.m))
        return np.where(a > 0, np.clip(np.log(np.maximum(a, 0.01) / max(1, self.n) / np.maximum(rate, 1e-9)), 0.0, 4.0), 0.0)

    def sums(self, doc: list[str], own_bad: int = 0, own_good: int = 0) -> np.ndarray:
        """Evidence of each sentence of a document, by the root of its length."""
        owner, slots = _slots(doc)
        w = self.odds(slots, own_bad, own_good)
        size = np.maximum(np.bincount(owner, minlength=len(doc)), 1)
        return np.bincount(owner, weights=np.where(w >= EVIDENT, w, 0.0), minlength=len(doc)) / np.sqrt(size)


def _top(machine: Machine | None, texts: list[str | None]) -> np.ndarray:
    parts = [sentences(t) for t in texts]
    scores = machine.scores([s for p in parts for s in p]) if machine else np.zeros(sum(map(len, parts)))
    stop = np.cumsum([len(p) for p in parts])
    return np.array([scores[e - len(p) : e].max() if p else EMPTY for p, e in zip(parts, stop)])


def offset_by_validation(reviewed: list[tuple[str | None, bool]], counts: np.ndarray) -> float:
    """The place of the threshold that does best on the second half of the reviewed documents, for a machine trained on the first."""
    halves: tuple[list, list] = ([], [])
    for k, (t, a) in enumerate(sorted(reviewed, key=lambda r: (r[1], len(r[0] or ""), r[0] or ""))):
        halves[k % 2].append((t, a))
    machine = train(halves[0], counts, OFFSETS[0])
    if machine is None or machine.span <= 0:
        return OFFSETS[len(OFFSETS) // 2]
    top = _top(machine, [t for t, _ in halves[1]])
    is_bad = np.array([a for _, a in halves[1]], dtype=bool)
    if not is_bad.any() or is_bad.all():
        return OFFSETS[len(OFFSETS) // 2]

    def gain(f: float) -> float:
        flagged = top > (f - OFFSETS[0]) * machine.span
        return flagged[is_bad].mean() - ALARM_COST * flagged[~is_bad].mean()

    best = max(gain(f) for f in OFFSETS)
    near = [f for f in OFFSETS if gain(f) >= best - 1e-9]
    return near[len(near) // 2]


def train(reviewed: list[tuple[str | None, bool]], counts: np.ndarray, offset: float | None = None) -> Machine | None:
    """The machine for reviewed texts (text, abusive); `counts` are those of `fill_runs` over all documents.

    Without an `offset` it is chosen by validation inside the reviewed documents.
    """
    bad = [s for t, a in reviewed if a and (s := sentences(t))]
    harmless = [s for t, a in reviewed if not a and (s := sentences(t))]
    good = sorted({s for doc in harmless for s in doc})
    if not bad or not good:
        return None
    if offset is None:
        offset = offset_by_validation(reviewed, counts)
    evidence = Evidence(bad, harmless, counts)
    usual_ = [evidence.sums(doc, own_good=1) for doc in harmless]
    least = max(float(np.quantile(np.concatenate(usual_), QUIET)), 1e-9)
    witness = []
    for doc in bad:
        sums = evidence.sums(doc, own_bad=1)
        witness += [s for s, v in zip(doc, sums) if v > max(least, 0.6 * sums.max())]
    if not witness:
        return None
    hot = evidence.odds(np.arange(len(counts) - 1)) >= EVIDENT
    heat = dict(zip((s for doc in harmless for s in doc), np.concatenate(usual_).tolist()))

    def core(s: str) -> str:
        """The passage itself, without what stands around it in a run-on sentence."""
        width = 3 if sum(ord(c) >= 0x2E80 for c in s) * 2 > len(s) else 6
        index = []
        slot = _slots([s], index)[1]
        at = sorted(np.concatenate(index)[hot[slot]].tolist())
        best: list[int] = []
        part: list[int] = []
        for k in at:  # the longest stretch of such runs without a wide gap
            part = [*part, k] if part and k - part[-1] <= 3 * width else [k]
            best = part if len(part) > len(best) else best
        return s[max(0, best[0] - 1) : best[-1] + width + 1] if best else ""

    near = sorted(good, key=lambda s: (-heat[s], s))
    machine = None
    for _ in range(3):
        marks = _diverse([c for s in witness if len(c := core(s)) >= 4], LANDMARKS)
        kernel = Kernel(marks).without(good)
        at, k = kernel.values(marks)
        gram = np.zeros((len(marks), len(marks)))
        gram[at] = k
        gram /= np.sqrt(kernel.own)[:, None]  # the kernel among the landmarks, all of unit length
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        whitening = vectors / np.sqrt(np.maximum(values, 0.05)) @ vectors.T
        texts = witness + near[:MAX_HARMLESS]
        y = np.r_[np.ones(len(witness)), -np.ones(len(texts) - len(witness))]
        x = np.zeros((len(texts), len(marks)))
        at, k = kernel.values(texts)
        x[at] = k
        w, b = _svm(x @ whitening, y)
        machine = Machine(kernel, whitening, w, b)
        worst, usual = float(np.quantile(machine.scores(good), 0.9995)), float(np.median(machine.scores(witness)))
        machine.span = usual - worst
        if worst < usual:  # between the highest harmless sentences and the usual abusive one
            machine.bias -= worst + offset * (usual - worst)
        again = []
        for doc in bad:  # what the machine flags; in documents without such a sentence the best one, if it stands out from harmless ones
            v = machine.scores(doc)
            again += [t for t, x in zip(doc, v) if x > min(0.0, max(float(v.max()) - 1e-9, -offset * max(machine.span, 0.0)))]
        if not again or sorted(set(again)) == sorted(set(witness)):
            break
        witness = again
        scores = machine.scores(good)
        wrong = [t for t, v in zip(good, scores) if v > scores.min() + 1e-9]
        near = list(dict.fromkeys(wrong + near))
    return machine


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in batches:
            parts = [sentences(t) for t in batch.column(2).to_pylist()]
            flat = [s for p in parts for s in p]
            values = m.scores(flat) if flat and m is not None else np.full(len(flat), EMPTY)
            stop = np.cumsum([len(p) for p in parts])
            score = [float(values[e - len(p) : e].max()) if p else EMPTY for p, e in zip(parts, stop)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "source", "score"])

    return run


def abuse_scores(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, source, score) for every row of `docs(doc_id, source, text)`; `reviews(doc_id, abusive)` label some of them."""
    labels = reviews.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.max("abusive").alias("abusive")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_REVIEWED)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", "abusive").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    counts = summed_table(docs.select("text"), fill_runs, (1 << TABLE_BITS) + 1)
    machine = docs.sparkSession.sparkContext.broadcast(train([(r.text, bool(r.abusive)) for r in rows], counts))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(_score(machine), "doc_id long, source string, score double")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return abuse_scores(table(spark, folder, "documents", ["doc_id", "source", "text"]), table(spark, folder, "review_label"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("score > 0").select("doc_id").distinct()


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document."""
    return _scored(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of flagged documents of each source."""
    return _scored(spark, folder).groupBy("source").agg(F.count("*").alias("documents"), F.avg((F.col("score") > 0).cast("double")).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
