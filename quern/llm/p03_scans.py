"""Problem 3: noise in text from scanned pages.

A first pass counts words, character trigrams and header shapes over all scanned files.
From these are learned the vocabulary, which characters are misread as which, and how
running headers begin and end; nothing is ranked and cut off: words and trigrams count as
known from a share of the corpus on, so that the tables sent to the executors have a size
that does not follow the corpus. A second pass marks each file's
lines: page numbers (number sequences alone on their lines), running headers (fuzzily
repeated lines at page edges, or lines of a learned header shape), words cut at line ends
(the joined word beats the hyphenated compound in the vocabulary) and lines with
misrecognised characters. `repair_scans` joins the rest into paragraphs.

Null and empty texts have no marks and come back as they are; text without line ends is
one line. Copies of a file yield each mark once. An empty table yields no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._text import code_points, letters_only
from quern.sources.tables import table

#: Least count of a known word, trigram or header shape, and the least share of all words or trigrams (there are at most
#: 1 / share of either; below 30 million words or 150 million trigrams the least count is the greater one).
LEAST, WORD_SHARE, TRIGRAM_SHARE = 3, 1e-7, 2e-8
#: A word may be a misreading if the right word is OFTEN times as frequent, or if it stays within twice the rate learned for that misreading.
OFTEN = 15

# Ways in which a page number stands alone on its line.
PAGE_NUMBER = re.compile(
    r"^(?:[-–—·•*~\[(（【<《|.]\s*){0,2}(?:(?:page|pag\.?|pg\.?|p\.?|no\.?|第)\s*)?(\d{1,4}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})\s*(?:页|頁)?\s*"
    r"(?:(?:[/／|]|of|,|，|共)\s*(?:共\s*)?\d{1,4}\s*(?:页|頁)?)?\s*(?:[-–—·•*~\])）】>》|.]\s*){0,2}$",
    re.I,
)
_ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_HYPHEN = re.compile(r"([^\W\d_][^\W_]*)[-‐‑\xad¬]\s*$")
_HEAD_WORD = re.compile(r"^\s*([^\W\d_][^\W_]*)")
_WORD = re.compile(r"[^\W_]*[A-Za-z][^\W_]*")
_COMPOUND = re.compile(r"[A-Za-z]+(?:[-‐‑][A-Za-z]+)+")
_HAN = re.compile(r"[一-鿿]")
_MISREAD_NUMBER = re.compile(r"^(?=.*\d)(?=.*[lIOoSB])[0-9lIOoSB]{2,4}$")
_THREE_LETTERS = re.compile(r"[^\W\d_].*?[^\W\d_].*?[^\W\d_]")
_NUMBERED_WORD = re.compile(r"^\W*([^\W\d_]+)\s+#")
_DIGITS, _LETTERS = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")
_NOT_HAN = re.compile(r"[^一-鿿ぁ-ヿ#]")
_STRIP = " \t\r\v\f　\xa0﻿"


def _number(line: str) -> int | None:
    """The number of a line that holds only a page number."""
    if len(line) > 60:
        line = " ".join(line.split())
    if not line or len(line) > 60:  # with single spaces the pattern has no longer match
        return None
    m = PAGE_NUMBER.match(line)
    if not m or line[-1] == "." and line[0].isdigit():
        return None
    said = m.group(1)
    if said.isdigit():
        return int(said)
    if not _ROMAN.match(said) or said.lower() != said and said.upper() != said:
        return None
    value, last = 0, 0
    for c in reversed(said.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
        value, last = value + (v if v >= last else -v), max(v, last)
    return value


def page_numbers(lines: list[str]) -> list[int]:
    """Indices of the page-number lines.

    Numbers of files with several must belong to the longest chain that grows by small
    steps; a bare Roman numeral alone needs company or a frame.
    """
    found = [(k, n) for k, line in enumerate(lines) if (n := _number(line)) is not None]
    if len(found) < 2:
        return [k for k, _ in found if any(c.isdigit() for c in lines[k]) or len(lines[k]) > 2]
    best: list[tuple[int, int]] = []  # per index: length of its chain, previous
    ends: dict[int, int] = {}  # number -> first index with the longest chain that ends in it
    for j, (_, n) in enumerate(found):
        before = [ends[m] for m in (n - 1, n - 2, n - 3) if m in ends]
        back = max(before, key=lambda i: (best[i][0], -i)) if before else -1
        best.append((best[back][0] + 1 if before else 1, back))
        if n not in ends or best[j][0] > best[ends[n]][0]:
            ends[n] = j
    at = max(range(len(best)), key=lambda j: best[j][0])
    if best[at][0] == 1:
        return [k for k, _ in found if not lines[k][:1].isalpha()]
    chain = []
    while at >= 0:
        chain.append(found[at][0])
        at = best[at][1]
    return chain[::-1]


def _cues(line: str) -> list[str]:
    """Shape of a title line: its first words, or the last four Han characters, digits as one sign."""
    flat = _DIGITS.sub("#", line)
    if not flat.isascii() and _HAN.search(flat):
        bare = _NOT_HAN.sub("", flat).strip("#")
        return [bare[:3]] if bare.startswith("第#") else [">" + bare[-4:]] if len(bare) >= 6 else []
    flat = flat.lower()
    numbered = _NUMBERED_WORD.match(flat)
    if numbered:
        return [numbered.group(1) + " #"]
    words = _LETTERS.findall(flat)
    return [" ".join(words[:2])] if len(words) >= 2 else []


def _title_like(line: str) -> bool:
    return 3 <= len(line) <= 90 and line[-1] not in "。，、；：！？,;:!?" and line[0] not in "#|" and _THREE_LETTERS.search(line) is not None


def _repeated(lines: list[str], pages: set[int], opening: int) -> dict[int, bool]:
    """Title-like lines that recur fuzzily; True where all of a group stand at page edges, carry page numbers or repeat the opening heading."""
    keys: dict[int, str] = {k: letters_only(line) for k, line in enumerate(lines) if k not in pages and _title_like(line)}
    counts = Counter(keys.values())
    groups: dict[str, list[int]] = defaultdict(list)
    for k, key in keys.items():
        groups[key].append(k)
    heads: dict[str, list[str]] = defaultdict(list)
    for h in (g for g, n in counts.items() if n >= 2):
        heads["<" + h[:3]].append(h)
        heads[">" + h[-3:]].append(h)
    for g in list(groups):  # one misread character or two joins a lone line to a repeated one
        if counts[g] == 1 and len(g) >= 6:
            for h in dict.fromkeys(heads.get("<" + g[:3], []) + heads.get(">" + g[-3:], [])):
                if abs(len(h) - len(g)) <= 2 and SequenceMatcher(None, g, h, autojunk=False).ratio() >= 0.86:
                    groups[h] += groups.pop(g)
                    break
    solid = [k for k, line in enumerate(lines) if line]
    near = set()
    for a, b in zip(solid, solid[1:]):
        if a in pages:
            near.add(b)
        if b in pages:
            near.add(a)
    first = keys.get(opening) or letters_only(lines[opening]) if opening >= 0 else ""
    out = {}
    for key, members in groups.items():
        if len(members) < 2:
            continue
        members.sort()
        tails = [re.search(r"(?:^(\d{1,4})\s+\D)|(?:\D\s+(\d{1,4})$)", lines[k]) for k in members]
        numbers = [int(t.group(1) or t.group(2)) for t in tails if t]
        numbered = len(numbers) == len(members) and all(0 < y - x <= 4 for x, y in zip(numbers, numbers[1:]))
        edge = sum(k in near or k == opening for k in members) >= 0.8 * len(members)
        for k in members:
            out[k] = edge or numbered or key == first
    return out


def _opening(lines: list[str]) -> int:
    return next((k for k, line in enumerate(lines) if line), -1)


def with_gaps(cues: set[str]) -> set[str]:
    """The shapes, and the endings of Han titles with each character left open once."""
    return cues | {c[:k] + "\0" + c[k + 1 :] for c in cues if c[0] == ">" and len(c) == 5 for k in range(1, 5)}


def headers(lines: list[str], pages: set[int], cues: set[str]) -> set[int]:
    """Indices of running headers; the heading that opens the text is none."""
    opening = _opening(lines)
    found = {k for k, sure in _repeated(lines, pages, opening).items() if sure}
    if cues:
        for k, line in enumerate(lines):
            if k not in pages and k != opening and _title_like(line) and len(line) <= 80:
                own = _cues(line)
                if any(c in cues or c[0] == ">" and len(c) == 5 and any(c[:j] + "\0" + c[j + 1 :] in cues for j in range(1, 5)) for c in own):
                    found.add(k)
    found.discard(opening)
    return found


# ---------------------------------------------------------------- first pass


def _plain_lines(text: str) -> list[str]:
    return [line.strip(_STRIP) for line in text.split("\n")]


def _running(lines: list[str], skip: set[int]) -> tuple[str, np.ndarray]:
    """Lines without `skip` joined directly, and the line index of each character."""
    kept = [k for k in range(len(lines)) if k not in skip and lines[k]]
    return "".join(lines[k] for k in kept), np.repeat(np.array(kept, dtype=np.int64), [len(lines[k]) for k in kept])


def _collapsed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of digits as one 0; the positions kept."""
    digit = (points >= 48) & (points <= 57)
    keep = np.flatnonzero(~(digit & np.r_[False, digit[:-1]]))
    p = points.astype(np.int64)
    p[digit] = 48
    return p[keep], keep


def _trigrams(p: np.ndarray) -> np.ndarray:
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:] if len(p) > 2 else np.zeros(0, dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    cues: Counter = Counter()
    grams: list[np.ndarray] = []

    def flush():
        if grams:
            values, n = np.unique(np.concatenate(grams), return_counts=True)
            grams.clear()
            yield pa.RecordBatch.from_arrays([pa.array(["t"] * len(values), pa.string()), pa.array([""] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["kind", "word", "gram", "n"])

    held = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            lines = _plain_lines(text)
            pages = set(page_numbers(lines))
            opening = _opening(lines)
            repeated = _repeated(lines, pages, opening)
            sure = {k for k, yes in repeated.items() if yes}
            for k, line in enumerate(lines):
                if k not in pages and k != opening and _title_like(line) and len(line) <= 80:
                    for c in _cues(line):
                        cues[("h" if k in sure else "o") + c] += 1
            whole, _ = _running(lines, pages | sure)
            if len(_HAN.findall(whole)) * 4 > len(whole):
                p, _ = _collapsed(code_points(whole))
                grams.append(_trigrams(p))
                held += len(p)
            for k, line in enumerate(lines):
                if k not in pages and k not in sure and line and not line.isdigit():
                    found = _WORD.findall(line)
                    if found:
                        if line[-1] in "-‐‑\xad¬":
                            found = found[:-1]
                        words.update(w.lower() for w in found)
                        words.update(c.lower().replace("‐", "-").replace("‑", "-") for c in _COMPOUND.findall(line[:-1]))
            if held > 4_000_000:
                yield from flush()
                held = 0
    yield from flush()
    for kind, counted in (("w", words), ("c", cues)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(counted), pa.string()), pa.array(list(counted), pa.string()), pa.array([0] * len(counted), pa.int64()), pa.array(list(counted.values()), pa.int64())], ["kind", "word", "gram", "n"]
        )


class Knowledge:
    """What the first pass learned: counts of known words and trigrams, header shapes, misread letters with their rates."""

    def __init__(self, words: dict[str, int], total: int, grams: np.ndarray, counts: np.ndarray, cues: set[str], swaps: list[tuple[str, str, float]]):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order]
        self.words = words
        self.cues = with_gaps(cues)
        self.misread = self._misread_signs()
        self.swaps: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for wrong, right, rate in sorted(swaps):
            self.swaps[wrong].append((right, rate))
        self.swaps = dict(self.swaps)
        self.known = max(LEAST + 2, total // 1_000_000 * 3)
        #: from here on a word is an everyday one
        self.common = max(20, total // 100_000)

    def _misread_signs(self) -> dict[int, list[int]]:
        """x -> characters y that x replaces: x is rare where y is nearly certain, in several contexts of each kind."""
        mask = (1 << 21) - 1
        a, x, b = self.grams >> 42, (self.grams >> 21) & mask, self.grams & mask
        votes: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
        for kind, (ctx, sign) in enumerate((((a << 21) | b, x), ((a << 21) | x, b), ((x << 21) | b, a))):
            if not len(ctx):
                continue
            order = np.lexsort((-self.counts, ctx))
            c, s, n = ctx[order], sign[order], self.counts[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[first, len(c)])
            total = np.add.reduceat(n, first)
            strong = (n[first] >= 20) & (n[first] >= 0.7 * total) & (size > 1)
            for f, k in zip(first[strong], size[strong]):
                y, top = int(s[f]), n[f]
                for j in range(f + 1, f + k):
                    if n[j] <= 0.08 * top:
                        votes[(int(s[j]), y)][kind] += 1
        out: dict[int, list[int]] = defaultdict(list)
        for (wrong, right), (m, l, r) in votes.items():
            if m >= 1 and l >= 1 and r >= 1 and m + l + r >= 4 and chr(wrong).isalpha() and chr(right).isalpha():
                out[wrong].append(right)
        return dict(out)

    def seen(self, grams: np.ndarray) -> np.ndarray:
        """Counts of packed trigrams, 0 for those not kept."""
        if not len(self.grams):
            return np.zeros(len(grams), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.counts[at], 0)

    def reading(self, word: str, among: Counter | None = None) -> int:
        """Where `word` departs from the known word that it misreads, -1 if it does not; `among` are names of the same text."""
        own = self.words.get(word, 0) if among is None else 0
        for k in range(len(word)):
            for width in (1, 2):
                for t, rate in self.swaps.get(word[k : k + width], ()):
                    other = word[:k] + t + word[k + width :]
                    if among is not None:
                        if among.get(other, 0) >= 2:
                            return k
                    elif (n := self.words.get(other, 0)) >= 20 and (n >= OFTEN * own or own <= 2 * rate * (own + n)):
                        return k
        return -1


def misread_letters(words: DataFrame) -> DataFrame:
    """(wrong, right, rate): letter groups read for others, from the counts `words(word, n)`.

    Words that differ in one such group are compared with the most frequent of them. A
    group counts as misread if it makes five words or more OFTEN times rarer, or if it
    makes words at least four times rarer and hardly ever leads to a frequent word.
    """
    usable = words.where(F.length("word").between(4, 24) & ~F.col("word").contains("-"))
    cells = usable.select("word", "n", F.explode(F.expr("sequence(1, length(word))")).alias("k")).select("word", "n", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("w")).where("k + w - 1 <= length(word)")
    cells = cells.selectExpr("word", "n", "substring(word, k, w) part", "concat(substring(word, 1, k - 1), '*', substring(word, k + w)) masked")
    top = cells.groupBy("masked").agg(F.max(F.struct("n", "word", "part")).alias("top"), F.count("*").alias("forms")).where("forms > 1 and top.n >= 20").select("masked", F.col("top.n").alias("often"), F.col("top.word").alias("best"), F.col("top.part").alias("right"))
    pairs = cells.withColumnRenamed("part", "wrong").join(top, "masked").where("wrong <> right and length(wrong) + length(right) < 4 and not contains(right, wrong) and not contains(wrong, right)")
    rare = F.col("n") * 4 <= F.col("often")
    found = pairs.groupBy("wrong", "right").agg(
        F.countDistinct(F.when(F.col("n") * OFTEN <= F.col("often"), F.col("best"))).alias("strong"),
        F.countDistinct(F.when(rare, F.col("best"))).alias("support"),
        F.countDistinct(F.when(~rare, F.col("best"))).alias("contrary"),
        F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("seldom"),
        F.sum(F.when(rare, F.col("often")).otherwise(0)).alias("usual"),
    )
    kept = found.where("strong >= 5 or support >= 5 and support >= 4 * contrary")
    return kept.select("wrong", "right", (F.col("seldom") / (F.col("seldom") + F.col("usual"))).alias("rate"))


def header_shapes(cues: DataFrame) -> DataFrame:
    """Shapes of `cues(word, n)` (marked h or o) that mostly belong to sure headers."""
    mark, n = F.substring("word", 1, 1), F.col("n")
    shapes = cues.groupBy(F.expr("substring(word, 2)").alias("shape")).agg(F.sum(F.when(mark == "h", n).otherwise(0)).alias("h"), F.sum("n").alias("n"))
    return shapes.where("h >= 4 and h >= 0.5 * n and length(shape) > 2").select("shape")


def learn(texts: DataFrame) -> Knowledge:
    """Counts over all rows of `texts(text)`, added in Spark; collected is what counts as known."""
    counted = texts.select("text").mapInArrow(_count, "kind string, word string, gram long, n long").groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        totals = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        least = lambda kind, share: max(LEAST, int(totals.get(kind, 0) * share))
        words = counted.where((F.col("kind") == "w") & (F.col("n") >= least("w", WORD_SHARE))).select("word", "n")
        swaps = [tuple(r) for r in misread_letters(words).collect()]
        cues = {r.shape for r in header_shapes(counted.where((F.col("kind") == "c") & (F.col("n") >= LEAST))).collect()}
        grams = counted.where((F.col("kind") == "t") & (F.col("n") >= least("t", TRIGRAM_SHARE))).select("gram", "n").toArrow()
        known = {r.word: r.n for r in words.collect()}
    finally:
        counted.unpersist()
    return Knowledge(known, sum(known.values()), grams.column(0).to_numpy(), grams.column(1).to_numpy(), cues, swaps)


# ---------------------------------------------------------------- second pass


def _misread_english(lines: list[str], skip: set[int], hyphens: dict[int, tuple[str, int, str]], known: Knowledge, cache: dict[str, int]) -> set[int]:
    """Lines with a word that misreads a known word, or a name of the same text."""
    found: set[int] = set()
    names: Counter = Counter()
    pending: list[tuple[int, str]] = []
    tails = {nxt: head for _, nxt, head in hyphens.values()}
    for k, line in enumerate(lines):
        if k in skip or not line or line.startswith("#"):
            continue
        words = _WORD.findall(line)
        if k in tails and words and words[0] == tails[k]:
            words = words[1:]
        if k in hyphens and words:
            words = words[:-1]
            part, nxt, head = hyphens[k]
            whole = (part + head).lower()
            if known.words.get(whole, 0) < known.known:
                at = known.reading(whole)
                if at >= 0:
                    found.add(k if at < len(part) else nxt)
        for w in words:
            low = w.lower()
            if low != w and not w.isupper():
                names[low] += 1
            at = cache.get(low)
            if at is None:
                at = -1 if len(low) < 3 else known.reading(low)
                cache[low] = at
            if at >= 0 or _MISREAD_NUMBER.match(w):
                found.add(k)
            elif low != w:
                pending.append((k, low))
    for k, low in pending:
        if names[low] == 1 and len(low) >= 5 and known.words.get(low, 0) < known.common and known.reading(low, names) >= 0:
            found.add(k)
    return found


def _cut_words(lines: list[str], skip: set[int], known: Knowledge) -> dict[int, tuple[str, int, str]]:
    """Lines that end inside a word: the part before the cut, the next text line, its first word."""
    out = {}
    for k, line in enumerate(lines):
        if k in skip or not line or line[-1] not in "-‐‑\xad¬":
            continue
        m = _HYPHEN.search(line)
        if not m:
            continue
        nxt = next((j for j in range(k + 1, len(lines)) if lines[j] and j not in skip), -1)
        head = _HEAD_WORD.match(lines[nxt]) if nxt >= 0 else None
        if not head:
            continue
        part, rest = m.group(1), head.group(1)
        joined = known.words.get((part + rest).lower(), 0)
        # the compound may go on: "well-to-" + "do"
        longer = re.search(r"([A-Za-z]+(?:[-‐‑][A-Za-z]+)*)[-‐‑\xad¬]\s*$", line)
        left = longer.group(1) if longer else part
        tail = re.match(r"\s*([A-Za-z]+(?:[-‐‑][A-Za-z]+)*)", lines[nxt])
        compound = max(known.words.get(f"{p}-{t}".lower(), 0) for p in (part, left) for t in (rest, tail.group(1) if tail else rest))
        if joined > compound:
            out[k] = (part, nxt, rest)
        elif not compound:
            both = min(known.words.get(part.lower(), 0), known.words.get(rest.lower(), 0))
            if both < 3 * known.common or part[:1].isupper():
                out[k] = (part, nxt, rest)
    return out


def _misread_han(batch: list[tuple[int, list[str], set[int]]], known: Knowledge) -> dict[int, dict[int, list[tuple[int, str]]]]:
    """For each text of the batch: lines with misread characters, as (offset in the line, right character)."""
    out: dict[int, dict[int, list[tuple[int, str]]]] = defaultdict(lambda: defaultdict(list))
    wrong = np.array(sorted(known.misread), dtype=np.int64)
    parts, owners, where, offsets = [], [], [], []
    for key, lines, skip in batch:
        whole, line_of = _running(lines, skip)
        if len(whole) > 4:
            p, kept = _collapsed(code_points(whole))
            start = np.r_[0, np.flatnonzero(np.diff(line_of)) + 1] if len(line_of) else np.zeros(0, dtype=np.int64)
            first = np.zeros(len(line_of), dtype=np.int64)
            first[start] = start
            parts.append(np.r_[p, 0, 0])
            owners.append(np.full(len(p) + 2, key))
            where.append(np.r_[line_of[kept], -1, -1])
            offsets.append(np.r_[(np.arange(len(line_of)) - np.maximum.accumulate(first))[kept], -1, -1])
    if not parts or not len(wrong):
        return out
    p, owner, line, offset = (np.concatenate(v) for v in (parts, owners, where, offsets))
    at = np.flatnonzero(np.isin(p, wrong) & (line >= 0))
    at = at[(at >= 2) & (at < len(p) - 2)]
    z, a, x, b, c = p[at - 2], p[at - 1], p[at], p[at + 1], p[at + 2]
    pack = lambda u, v, w: (u << 42) | (v << 21) | w
    score_x = sum(np.log(known.seen(pack(*g)) + 0.5) for g in ((z, a, x), (a, x, b), (x, b, c)))
    best, right = np.full(len(at), -np.inf), np.zeros(len(at), dtype=np.int64)
    for rank in range(max(map(len, known.misread.values()))):
        y = np.array([known.misread[int(v)][rank] if rank < len(known.misread[int(v)]) else 0 for v in x], dtype=np.int64)
        seen = [known.seen(pack(*g)) for g in ((z, a, y), (a, y, b), (y, b, c))]
        score = np.where((y > 0) & (np.maximum.reduce(seen) >= 6), sum(np.log(s + 0.5) for s in seen), -np.inf)
        better = score > best
        best[better], right[better] = score[better], y[better]
    for k in np.flatnonzero(best - score_x >= 4.0):
        out[int(owner[at[k]])][int(line[at[k]])].append((int(offset[at[k]]), chr(right[k])))
    return out


def _analyse(texts: list[str | None], known: Knowledge, cache: dict[str, int]):
    """For each text: lines, page numbers, headers, cut words, misread lines, corrections of Han characters."""
    rows, batch = [], []
    for key, text in enumerate(texts):
        lines = _plain_lines(text or "")
        pages = set(page_numbers(lines))
        heads = headers(lines, pages, known.cues)
        skip = pages | heads
        cut = _cut_words(lines, skip, known)
        batch.append((key, lines, skip))
        rows.append((lines, pages, heads, cut, _misread_english(lines, skip, cut, known, cache)))
    han = _misread_han(batch, known)
    return [(*r, han.get(k, {})) for k, r in enumerate(rows)]


def _mark(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, cache = known.value, {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for key, (_, pages, heads, cut, misread, han) in zip(ids, _analyse(texts, k, cache)):
                for kind, at in (("page_no", pages), ("header", heads), ("hyphen", cut), ("char", set(misread) | set(han))):
                    out += [(key, j + 1, kind) for j in sorted(at)]
            if len(cache) > 500_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], ["text_id", "line_no", "noise"])

    return run


def _joined_paragraphs(text: str | None, found) -> str | None:
    if not text:
        return text
    lines, pages, heads, cut, _, han = found
    paragraphs: list[str] = []
    current, glue = "", True
    for k, line in enumerate(lines):
        if k in pages or k in heads:
            continue
        if not line:
            if current and not glue and current[-1] in "。.!?！？:：”\"')）":
                paragraphs.append(current)
                current = ""
            continue
        fixed = list(line)
        for at, right in han.get(k, ()):
            fixed[at] = right
        line = "".join(fixed)
        if k in cut:
            line = line.rstrip(" -‐‑\xad¬")
        if line.startswith("#") or not current:
            if current:
                paragraphs.append(current)
            current = line
            if line.startswith("#"):
                paragraphs.append(current)
                current = ""
        else:
            han_join = _HAN.match(line[0]) or _HAN.match(current[-1]) or ord(current[-1]) > 0x2E7F or ord(line[0]) > 0x2E7F
            current += ("" if glue or han_join else " ") + line
        glue = k in cut
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def _repair(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, cache = known.value, {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [_joined_paragraphs(t, f) for t, f in zip(texts, _analyse(texts, k, cache))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["text_id", "text"])

    return run


def scan_noise(scans: DataFrame) -> DataFrame:
    """(text_id, line_no, noise) for all rows of `scans(text_id, text)`."""
    known = scans.sparkSession.sparkContext.broadcast(learn(scans))
    marks = scans.select(F.col("text_id").cast("long"), "text").mapInArrow(_mark(known), "text_id long, line_no int, noise string")
    return marks.distinct()


def repair_scans(scans: DataFrame) -> DataFrame:
    """(text_id, text) with page furniture removed, cut words joined and lines run into paragraphs."""
    known = scans.sparkSession.sparkContext.broadcast(learn(scans))
    return scans.select(F.col("text_id").cast("long"), "text").mapInArrow(_repair(known), "text_id long, text string")


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "prepare_file").where("origin = 'scan'").select("text_id", "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise(_scans(spark, folder))


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Repaired text of every scanned file, once per key."""
    return repair_scans(_scans(spark, folder).dropDuplicates(["text_id"]))


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
ORACLES: dict[str, str] = {}
