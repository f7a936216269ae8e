"""Operators that prepare text for training language models.

Nothing outside this package imports it. The modules are loaded with the package, so that
a missing dependency shows as an ImportError of the package itself. `queries()` and
`oracle_sql()` gather what the modules register.
"""

from __future__ import annotations

import importlib

MODULES = ("p01_split", "p02_pairs", "p03_scans", "p04_lines", "p05_subjects", "p06_neardup", "p07_leaks", "p08_mix", "p09_abuse")


_LOADED = [importlib.import_module(f"{__name__}.{name}") for name in MODULES]


def queries() -> dict:
    out: dict = {}
    for module in _LOADED:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _LOADED:
        out |= module.ORACLES
    return out
