"""Training-data operators: whole-corpus text jobs that run on Spark at scale.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from . import bpe, embeddings, html_text, importance, lang_id, mixing, near_dup, quality, repeats, store, token_counts, url_filter, whitening

_MODULES = (repeats, bpe, embeddings, html_text, url_filter, lang_id, store, mixing, near_dup, quality, token_counts, whitening, importance)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
