"""Structured Streaming forms: device lines routed to commands, token streams put together."""

from quern.streaming.lines import commands, routed
from quern.streaming.tokens import assembled

__all__ = ["assembled", "commands", "routed"]
