"""Constants of the engine; fixed values."""

from __future__ import annotations

ALIAS_THRESHOLD = 0.88
CHUNK_TOKENS, CHUNK_OVERLAP = 350, 70
RRF_K = 60
SOURCE_WEIGHTS = {"graph": 1.3, "exact": 1.1, "vector": 1.0, "document": 1.0, "fts": 0.9}
SOURCE_PRIORITY = {"graph": 4, "exact": 3, "vector": 2, "fts": 1, "document": 0}
LOW_CONFIDENCE = 0.50
BM25_K1, BM25_B = 1.2, 0.75
#: mode: (candidate multiplier, least documents)
RECALL = {"fast": (1, 1), "balanced": (3, 4), "exhaustive": (6, 6)}
