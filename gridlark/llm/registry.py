"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import htmltext, media, mixing, packing, secrets, sharding, simhash, topk, toxicity, urlfilter

_MODULES = (htmltext, secrets, mixing, topk, sharding, urlfilter, simhash, media, toxicity, packing)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
