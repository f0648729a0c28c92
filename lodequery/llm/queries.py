"""The queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, chats, conversations, exact_dedup, fingerprints, mixing, pii, shards, simhash, substring_dedup, toxicity, url_filter

MODULES = (exact_dedup, toxicity, simhash, pii, fingerprints, bpe, shards, url_filter, substring_dedup, mixing, chats, conversations, alignment)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
