"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .chat import OP11_SQL, op11_chat_formatting
from .langid import op5_language_id
from .merkle import op10_document_fingerprints
from .mixing import OP7_SQL, op7_source_mixing
from .packing import op4_packing
from .search import OP12_SQL, op12_ranked_search
from .simhash import op1_simhash_near_dedup
from .substring import op9_substring_dedup
from .tokens import op2_token_counts
from .toxicity import op8_toxicity
from .trie import OP13_SQL, op13_prefix_trie
from .urls import OP3_SQL, op3_url_filters
from .vectors import OP6_SQL, op6_embedding_near_dedup

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op7_source_mixing": OP7_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
