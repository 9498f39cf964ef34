"""Training-data operators: deduplication, scoring, extraction, tokens, mixing, search.

Every module holds one operator and the thin ``opN_`` query over it; the
registries below gather those queries. Nothing outside this package (but the
guarded entry module and the pipeline) imports it.
"""

from __future__ import annotations

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (block_naming, bpe_rounds, bwt_merge, fill_middle, imatch, language_tags, ngram_join, page_differencing, posting_lists, prefix_trie, source_mixing, token_files, toxic_spans)  # noqa: F401,E402
