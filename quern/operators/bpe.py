"""Byte-pair encoding with the ranks of a vocabulary file, in Arrow batches.

The initial symbols are the bytes of a text; the adjacent pair whose joined bytes have the
lowest rank is merged, the leftmost first, until none is left. There is no split into
words before. Texts are encoded whole: runs of up to `run` bytes, cut between characters,
are encoded by themselves, so the work grows with the text and not with its square.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("QUERN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_RANKS: dict[int, dict[bytes, int]] = {}


def byte_symbols() -> list[str]:
    """A printable character for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def ranks_of(content: bytes) -> dict[bytes, int]:
    key = hash(content)
    if key not in _RANKS:
        _RANKS[key] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return _RANKS[key]


def encode(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a run of bytes; bytes without a rank are left out. A heap of pairs by (rank, place) over a linked list of parts."""
    parts: list[bytes | None] = [data[k : k + 1] for k in range(len(data)) if data[k : k + 1] in ranks]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, whole = heapq.heappop(heap)
        j = after[k]
        if parts[k] is None or j >= n or parts[k] + parts[j] != whole:
            continue  # one of the two has been merged since
        parts[k], parts[j] = whole, None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
        for a, b in ((before[k], k), (k, after[k])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


def encoder(content: bytes) -> Callable[[bytes], list[int]]:
    """The encoding of a run; a compiled one with the same merges where it is installed, for runs that are valid text."""
    ranks = ranks_of(content)
    try:
        import tiktoken
    except ImportError:
        return lambda data: encode(data, ranks)
    fast = tiktoken.Encoding("runs", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})

    def run(data: bytes) -> list[int]:
        try:
            return fast.encode_ordinary(data.decode("utf-8"))
        except UnicodeDecodeError:
            return encode(data, ranks)

    return run


def runs(text: str, run: int) -> Iterator[bytes]:
    """The bytes of a text in runs of at most `run`, cut between characters."""
    held, size = [], 0
    for ch in text:
        b = ch.encode("utf-8", "surrogatepass")
        if size + len(b) > run and held:
            yield b"".join(held)
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield b"".join(held)


def encoded_texts(docs: DataFrame, key: str, text: str, end: int | None = None, path: str = VOCABULARY, run: int = 512) -> DataFrame:
    """(key, ids) of each text that isn't blank, the id `end` behind each where given; the driver sends the vocabulary along."""
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_run = encoder(sent.value)
        for batch in batches:
            keys, out = [], []
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                if t and t.strip():
                    keys.append(k.as_py())
                    out.append([i for part in runs(t, run) for i in encode_run(part)] + ([end] if end is not None else []))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(out, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(batches_of, f"{key} {kind}, ids array<int>")


def merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(rank, left, right) of each token of several bytes: the parts it is merged from under the ranks before it; tokens whose parts are missing are skipped."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = encode(token, {t: r for t, r in _pieces(token, ranks) if r < rank})
            if len(parts) == 2:
                out.append((rank, *parts))
    return out


def _pieces(token: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[bytes, int]]:
    for a in range(len(token)):
        for b in range(a + 1, len(token) + 1):
            r = ranks.get(token[a:b])
            if r is not None:
                yield token[a:b], r
