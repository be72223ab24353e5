"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

TRIPLE = "struct<subject:string,object:string,predicate:string>"
EDGES = (
    "edge_ord long, src string, dst string, label string, source string, sentence string, original_sentence string, "
    "page_number int, start_index int, end_index int, doc_id string, chunk_id string, confidence double, "
    "extractor_version string, created_at timestamp, last_updated_at timestamp, extra map<string,string>"
)
NODES = "label string, created_at timestamp, last_updated_at timestamp"
SEED = "source string, relationship string, destination string"
RESPONSES = "prompt_hash string, raw string"
FEEDBACK = (
    "id string, ts timestamp, username string, exact_text string, filename string, page_number int, based_on string, "
    "decomposition string, decom_user_decision string, source string, s_user_decision string, target string, "
    "t_user_decision string, edge string, e_user_decision string, updated_decomposition string, "
    "updated_source string, updated_target string, updated_edge string"
)
TIMINGS = "name string, elapsed_seconds double, started_at timestamp, finished_at timestamp"
RETRIEVAL_LOG = (
    "keyword string, limit_per_pattern int, num_hits int, created_at string, "
    "hits array<struct<relation:string,match_pattern:string>>"
)
NOVELTY_LOG = (
    "num_results int, created_at string, results array<struct<quality:string,max_score:double,decision:string,"
    "rationale:string,novel_spans:array<string>,matched_neighbor_sentence:string,confidence:double>>"
)
QUALITIES_LOG = "num_docs int, created_at string, qualities array<string>"
