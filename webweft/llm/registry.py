"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from webweft.llm import (collocations, exact_dedup, jaccard_join, language_id, licenses, packing, periodic_runs,
                         permutation_index, quality, secrets, sentencepiece_codec, simhash, toxicity)

MODULES = [exact_dedup, packing, simhash, secrets, language_id, toxicity, permutation_index,
           sentencepiece_codec, licenses, quality, periodic_runs,
           collocations, jaccard_join]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in getattr(m, "SQL", {}).items()}
