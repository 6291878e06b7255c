"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from plumbline.llm import (
    arc_to_warc,
    cover_tree_topk,
    decontaminate,
    hilbert_shards,
    jaccard_join,
    language_id,
    line_dedup,
    merkle_manifest,
    piece_scan,
    prefix_trie,
    substring_dedup,
    token_files,
    toxicity,
)

MODULES = [hilbert_shards, line_dedup, jaccard_join, decontaminate, substring_dedup, toxicity, cover_tree_topk, language_id, token_files, piece_scan, arc_to_warc, prefix_trie, merkle_manifest]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
