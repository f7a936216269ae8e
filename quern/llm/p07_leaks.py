"""Problem 7: evaluation texts leaking into training text.

All test items form one generalised suffix automaton over tokens (single Han characters,
single digits, words of other scripts; NFKC and lower case, so case, width, spacing, line
breaks and punctuation don't matter). Each document's tokens are streamed through it and
the longest matching lengths tracked; maximal matches of `MIN_RUN` tokens and more, kept
with the items and positions where they occur, are chained along near-equal diagonals, so
that replaced words only break a match, not the chain. A chain that gives at least
`COVERAGE` of an item within the replacement limit is a leak; its span can be removed.

Null and empty documents hold nothing. An item with fewer than `MIN_RUN` tokens, or a
null one, can't leak. Items with the same text leak together. An item at least half of which
another one holds is matched against an automaton of its own as well, as its passage may
lie inside a longer match of the other. The held-out items are read by the driver; sets of
more than `SHARD_TOKENS` tokens get several automata, each of which sees every document.
Removal cuts the stored text; what stands outside the leaked spans stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table

MIN_RUN, COVERAGE, REPLACED = 5, 0.5, 0.1
#: Share of an item's tokens that must be matched before its matches are chained.
LEAST_SHARE = 0.3
#: Most tokens in one automaton (each worker builds it from the items' texts, about 200 MB).
SHARD_TOKENS = 250_000
#: Diagonals may drift by so many tokens between neighbouring matches of a chain, which lie at most GAP or the replaceable share of the item apart.
DRIFT, GAP = 3, 12
_TOKEN = re.compile(r"[一-鿿㐀-䶿豈-﫿ぁ-ヿ]|\d|[^\W\d_一-鿿㐀-䶿豈-﫿ぁ-ヿ]+")
_TIGHT = re.compile(r"(?<=[a-z])[-‐‑\xad¬]\s*\n\s*(?=[a-z])")


# Marks that combine with the character before them under NFKC; the other characters normalise on their own.
_CLUSTER = re.compile(r"(?s).[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0e31-\u0e4e\u1161-\u11ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f\uff9e\uff9f]*")


def placed_tokens(text: str) -> list[tuple[str, int, int]]:
    """The tokens of `tokens_of` with their first and last place (exclusive) in the stored text."""
    if text.isascii():
        flat, start, stop = text.lower(), range(len(text)), range(1, len(text) + 1)
    else:
        parts, start, stop = [], [], []
        for m in _CLUSTER.finditer(text):
            part = unicodedata.normalize("NFKC", m.group()).lower()
            parts.append(part)
            start += [m.start()] * len(part)
            stop += [m.end()] * len(part)
        flat = "".join(parts)
    keep, at = [], 0
    for m in _TIGHT.finditer(flat) if "\n" in flat else ():
        keep += range(at, m.start())
        at = m.end()
    if at:
        keep += range(at, len(flat))
        flat, start, stop = "".join(flat[k] for k in keep), [start[k] for k in keep], [stop[k] for k in keep]
    return [(m.group(), start[m.start()], stop[m.end() - 1]) for m in _TOKEN.finditer(flat)]


def tokens_of(text: str) -> list[str]:
    """Normalised tokens of a text; words cut at line ends are joined first."""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if "\n" in text:
        text = _TIGHT.sub("", text)
    return _TOKEN.findall(text)


class SuffixAutomaton:
    """Generalised: every item is inserted from the root; `where` lists (item, end) of a state's occurrences."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, tokens in enumerate(items):
            last = 0
            for end, t in enumerate(tokens):
                last = self._extend(last, t)
                self.own[last].append((item, end))
        self.children: dict[int, list[int]] = defaultdict(list)
        for state, up in enumerate(self.link):
            if up >= 0:
                self.children[up].append(state)
        self._where: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def where(self, state: int) -> list[tuple[int, int]]:
        found = self._where.get(state)
        if found is None:
            found, todo = [], [state]
            while todo:
                s = todo.pop()
                found += self.own.get(s, ())
                todo += self.children.get(s, ())
            self._where[state] = found
        return found

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches (end, length, state): each can't be continued by the document's next token."""
        following, link, lengths = self.next, self.link, self.length
        out, state, run = [], 0, 0
        for at, t in enumerate(tokens):
            n = following[state].get(t)
            if n is None:
                if run >= least:
                    out.append((at - 1, run, state))
                while n is None and state:
                    state = link[state]
                    n = following[state].get(t)
                if n is None:
                    run = 0
                    continue
                run = lengths[state]
            state = n
            run += 1
        if run >= least:
            out.append((len(tokens) - 1, run, state))
        return out


class Items:
    """The automaton with the items' ids, tokens and token weights (characters)."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(key, t) for key, text in rows if text and len(t := tokens_of(text)) >= MIN_RUN]
        self.ids: list[list[int]] = []
        texts: dict[tuple[str, ...], int] = {}
        for key, t in kept:
            at = texts.setdefault(tuple(t), len(texts))
            if at == len(self.ids):
                self.ids.append([])
            self.ids[at].append(key)
        self.words: dict[str, int] = {}
        self.tokens = [[self.words.setdefault(w, len(self.words)) for w in t] for t in texts]
        self.weight = []
        for t in texts:
            total = [0]
            for w in t:
                total.append(total[-1] + len(w))
            self.weight.append(total)
        self.automaton = SuffixAutomaton(self.tokens)
        # shared[a]: the items at least COVERAGE of whose tokens stand in runs of item a
        runs: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, t in enumerate(self.tokens):
            for k in range(len(t) - MIN_RUN + 1):
                runs[tuple(t[k : k + MIN_RUN])].append((item, k))
        covered: dict[tuple[int, int], set[int]] = defaultdict(set)
        for places in runs.values():
            for other in {i for i, _ in places} if len(places) > 1 else ():
                for item, k in places:
                    if item != other:
                        covered[item, other].update(range(k, k + MIN_RUN))
        self.shared: dict[int, list[int]] = defaultdict(list)
        for (item, other), places in covered.items():
            if len(places) >= COVERAGE * len(self.tokens[item]):
                self.shared[other].append(item)
        self._alone: dict[int, SuffixAutomaton] = {}

    def alone(self, item: int) -> SuffixAutomaton:
        if item not in self._alone:
            self._alone[item] = SuffixAutomaton([self.tokens[item]])
        return self._alone[item]


def _leaks(words: list[str], items: Items) -> list[tuple[int, int, int, float]]:
    known = items.words
    tokens = [known.get(w, -1) for w in words]
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for end, run, state in items.automaton.matches(tokens, MIN_RUN):
        for item, at in items.automaton.where(state):
            runs[item].append((at - run + 1, end - run + 1, run))
    for item in sorted({i for seen in runs for i in items.shared.get(seen, ())}) if items.shared else ():
        own = items.alone(item)  # its passage may lie hidden inside a longer match of the other item
        runs[item] = [(at - run + 1, end - run + 1, run) for end, run, state in own.matches(tokens, MIN_RUN) for _, at in own.where(state)]
    out = []
    for item, found in runs.items():
        n = len(items.tokens[item])
        if sum(r for *_, r in found) < LEAST_SHARE * n:
            continue
        best = _best_chain(sorted(found), tokens, items.tokens[item], items.weight[item])
        if best and best[2] >= COVERAGE:
            out.append((item, *best))
    return out


def leaks_in(text: str, items: Items) -> list[tuple[int, int, int, float]]:
    """(index of item, first token, last token, share of the item's text) of each leak in a document."""
    return _leaks(tokens_of(text), items)


def _best_chain(found: list[tuple[int, int, int]], doc: list[int], item: list[int], weight: list[int]) -> tuple[int, int, float] | None:
    """The chain of matches (item start, document start, length) that covers most of the item.

    Neighbours must lie in order, on diagonals at most DRIFT apart, with at most the
    permitted share of other tokens in between; matched tokens inside a gap are counted
    along the diagonal. Matches of one diagonal never overlap, so looking back along each
    diagonal in reach ends at the first match that lies too far before.
    """
    wide = max(GAP, int(REPLACED * len(item)))
    diagonals: dict[int, list[int]] = defaultdict(list)
    best: list[tuple[int, int, int, int]] = []  # covered weight, first doc token, matched tokens, other tokens
    answer = None
    for k, (i, d, r) in enumerate(found):
        own = (weight[i + r] - weight[i], d, r, 0)
        near = []
        for diagonal in range(d - i - DRIFT, d - i + DRIFT + 1):
            for j in reversed(diagonals.get(diagonal, ())):
                if i - (found[j][0] + found[j][2]) > wide:
                    break
                near.append(j)
        diagonals[d - i].append(k)
        for j in sorted(near):
            pi, pd, pr = found[j]
            gap_i, gap_d = i - (pi + pr), d - (pd + pr)
            if gap_i < 0 or gap_d < 0 or abs(gap_i - gap_d) > DRIFT or gap_i > wide or gap_d > wide:
                if pi < i < pi + pr and abs((i - d) - (pi - pd)) <= DRIFT and d > pd:  # overlapping matches
                    cut = max(pi + pr - i, pd + pr - d)
                    if cut < r:
                        c = best[j]
                        new = (c[0] + weight[i + r] - weight[i + cut], c[1], c[2] + r - cut, c[3])
                        if new[0] > own[0]:
                            own = new
                continue
            same = sum(item[pi + pr + x] == doc[pd + pr + x] for x in range(min(gap_i, gap_d)))
            other = max(gap_i, gap_d) - same
            c = best[j]
            matched, wrong = c[2] + r + same, c[3] + other
            if wrong <= max(2, 2 * REPLACED * (matched + wrong)):
                new = (c[0] + weight[i + r] - weight[pi + pr], c[1], matched, wrong)
                if new[0] > own[0]:
                    own = new
        best.append(own)
        # one in ten may be replaced; half as much again allows for uneven places
        if own[3] <= 1.5 * REPLACED * (own[2] + own[3]) + 1 and (answer is None or own[0] > answer[2]):
            answer = (own[1], d + r - 1, own[0])
    return answer and (answer[0], answer[1], answer[2] / weight[-1])


_BUILT: dict = {}


def _built(rows) -> Items:
    """The automaton of a broadcast shard, built once in a worker process."""
    key = hash(tuple(rows.value))
    if key not in _BUILT:
        _BUILT[key] = Items(rows.value)
    return _BUILT[key]


def _report(rows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_built(r) for r in rows]
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens_of(text) if text else ()
                for items in known if words else ():
                    for item, first, last, share in _leaks(words, items):
                        out += [(key, i, first, last, share) for i in items.ids[item]]
            kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), ["doc_id", "item_id", "first_token", "last_token", "share"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], names)

    return run


def shards_of(rows: list[tuple[int, str]], most: int) -> list[list[tuple[int, str]]]:
    """Items in shards of at most `most` tokens, a longer item by itself; items that share a run may fall apart, as each shard reports its own."""
    out, held = [], most
    for key, text in rows:
        size = len(tokens_of(text)) if text else 0
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append((key, text))
        held += size
    return out


def _sent_items(docs: DataFrame, items: DataFrame) -> list:
    rows = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().collect()
    return [docs.sparkSession.sparkContext.broadcast(shard) for shard in shards_of(sorted((r[0], r[1]) for r in rows), SHARD_TOKENS)]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_token, last_token, share): one row a leak, for `docs(doc_id, text)` and `items(item_id, text)`."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_report(_sent_items(docs, items)), "doc_id long, item_id long, first_token int, last_token int, share double")


def remove_leaks(text: str | None, shards: list[Items]) -> str | None:
    """The stored text without the spans of its leaks."""
    if not text:
        return text
    words = tokens_of(text)
    if not any(_leaks(words, items) for items in shards):
        return text
    placed = placed_tokens(text)
    words = [w for w, *_ in placed]
    gone = sorted((placed[a][1], placed[b][2]) for items in shards for _, a, b, _ in _leaks(words, items))
    out, at = [], 0
    for a, b in gone:
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join(out) + text[at:]


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) with the leaked spans removed."""
    rows = _sent_items(docs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_built(r) for r in rows]
        for batch in batches:
            texts = [remove_leaks(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", ["doc_id", "text"]), table(spark, folder, "eval_item", ["item_id", "text"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(*_tables(spark, folder)).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the leaked spans."""
    return without_leaks(*_tables(spark, folder))


QUERIES = {"p7_found": p7_found, "p7_cleaned": p7_cleaned}
ORACLES: dict[str, str] = {}
