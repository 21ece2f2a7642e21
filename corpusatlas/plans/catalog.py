"""All named queries and their SQL twins."""

from __future__ import annotations

from corpusatlas.plans import ages, corpus, inputs, more, reviews, structure, texts, vectors

MODULES = (ages, corpus, vectors, texts, structure, reviews, more, inputs)
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
