"""All queries and oracle statements of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("lm", "simhash", "tokens_output", "bpe", "sharding", "warc", "sketch", "quality", "suffixes", "decontaminate", "repair", "chat", "whitening")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
