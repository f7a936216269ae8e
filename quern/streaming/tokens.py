"""Token streams by request: characters from split bytes, spans of thought left out, quiet requests closed.

The state of a request holds the bytes of an unfinished character, the text of a mark that
may be going on and how long a thought has been open; it has a bounded size.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think", "</think>"
#: Tokens after which an open thought is given up, and milliseconds after which a quiet request is closed.
LONGEST, QUIET = 30, 60_000
_OUT = "request long, text string, closed boolean"
_STATE = "pending binary, held string, inside boolean, tokens int"


class Assembler:
    """Feeds tokens (bytes) of one request; `feed` returns the text that can be shown."""

    def __init__(self, pending: bytes = b"", held: str = "", inside: bool = False, tokens: int = 0):
        self.pending, self.held, self.inside, self.tokens = pending, held, inside, tokens

    def feed(self, token: bytes) -> str:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        text = decoder.decode(self.pending + token)
        self.pending = decoder.getstate()[0]
        self.held += text
        out = []
        if self.inside:
            self.tokens += 1
        while True:
            mark = CLOSE if self.inside else OPEN
            at = self.held.find(mark)
            if at >= 0:
                if not self.inside:
                    out.append(self.held[:at])
                self.held, self.inside, self.tokens = self.held[at + len(mark) :], not self.inside, 0
                continue
            keep = next((n for n in range(min(len(mark) - 1, len(self.held)), 0, -1) if mark.startswith(self.held[-n:])), 0)
            shown = self.held[: len(self.held) - keep]
            self.held = self.held[len(shown) :]
            if not self.inside:
                out.append(shown)
            elif self.tokens >= LONGEST:
                self.inside, self.tokens = False, 0
            return "".join(out)

    def close(self) -> str:
        rest = "" if self.inside else self.held + ("�" if self.pending else "")
        self.pending, self.held, self.inside = b"", "", False
        return rest


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    machine = Assembler(*state.get) if state.exists else Assembler()
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"request": [key[0]], "text": [machine.close()], "closed": [True]})
        return
    rows = pd.concat(list(frames)).sort_values("pos")
    text = "".join(machine.feed(bytes(t)) for t in rows["token"] if t is not None)
    if bool(rows["last"].fillna(False).any()):
        if state.exists:
            state.remove()
        yield pd.DataFrame({"request": [key[0]], "text": [text + machine.close()], "closed": [True]})
        return
    state.update((machine.pending, machine.held, machine.inside, machine.tokens))
    state.setTimeoutDuration(QUIET)
    yield pd.DataFrame({"request": [key[0]], "text": [text], "closed": [False]})


def assembled(tokens: DataFrame) -> DataFrame:
    """(request, text, closed) of a stream `tokens(request, pos, token, last)`: what each micro-batch adds to a request's visible text.

    A request is closed by its last token, or after a time without tokens.
    """
    return tokens.groupBy("request").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
