"""Table schemas, enumerations and error codes of the index."""

from __future__ import annotations


VERSION = 5
# The kinds of chunk, in alphabetical order.
CHUNK_TYPES = ("at_rule", "block", "class", "doc", "element", "enum", "function", "interface", "method", "mixin", "module", "namespace", "rule", "trait", "type")
EDGE_TYPES = ("CALLS", "CONTAINS", "IMPLEMENTS", "IMPORTS", "RE_EXPORTS")
DIMENSIONS = (128, 256, 512, 768, 1024, 1536)
# Largest number of characters of a chunk, by kind.
MAX_CHUNK_CHARS = {
    "module": 12_000, "class": 8_000, "function": 6_000, "method": 4_000, "trait": 6_000, "interface": 6_000,
    "enum": 6_000, "block": 4_000, "rule": 2_000, "at_rule": 4_000, "element": 4_000, "doc": 12_000,
}
# Error codes and their numbers.
ERRORS = {
    "AUTH_INVALID": -32010, "CONFIG_INVALID": -32011, "DIMENSION_MISMATCH": -32012, "SESSION_ALREADY_ACTIVE": -32020,
    "SESSION_BUSY": -32021, "SESSION_NOT_FOUND": -32022, "DECOMMISSION_DENIED": -32023, "PROVIDER_UNAVAILABLE": -32040,
    "CONTEXT_BUDGET_EXCEEDED": -32041, "INVALID_GRAPH_ENDPOINT": -32060, "INDEX_BATCH_FAILED": -32061,
    "FULL_REINDEX_REQUIRED": -32062, "INVALID_PATH": -32063,
}
# What a reply says about itself.
NOTES = {
    "INDEX_EMPTY": "[METADATA: INDEX_EMPTY]", "NO_MATCH": "[METADATA: NO_MATCH]", "NO_GRAPH_EDGES": "[METADATA: NO_GRAPH_EDGES]",
    "RERANKER_UNAVAILABLE": "[METADATA: RERANKER_UNAVAILABLE]",
}


class ConflictError(Exception):
    """Another writer has changed what a commit read or replaces."""


class EngineError(Exception):
    """An error with one of the codes of ERRORS."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.number = code, ERRORS[code]


#: DDL, so that importing needs no session.
CHUNKS = "id string, file_path string, chunk_type string, content string, start_line int, end_line int, is_deleted boolean, deleted_at timestamp, content_hash string"
NEW_CHUNK = "id string, file_path string, chunk_type string, content string, start_line int, end_line int, language string"
VECTORS = "id string, embedding array<float>"
EDGES = "source_id string, target_id string, edge_type string"
SCAN_CACHE = "file_path string, mtime_ns bigint, size_bytes bigint, content_hash string, last_scanned_at timestamp"
SESSIONS = "id string, name string, status string, generation_id int, secret_hash string, created_at timestamp, updated_at timestamp"
TURNS = "session_id string, turn_index int, role string, content string, ts timestamp"
LEDGER = (
    "seq bigint, id string, generation_id int, ts timestamp, status string, title string, context_and_problem string, "
    "decision_drivers array<string>, considered_options array<string>, decision_outcome string, supersedes string"
)
FINGERPRINT = "provider string, model_name string, model_revision string, dimensions int, normalization string, indexed_at timestamp"
#: What a source refers to: the places that its specifier may mean, the name there (empty: the module
#: itself, `*`: all names) and the name under which a re-export passes it on.
REFERENCES = "file_path string, source_id string, targets array<string>, name string, edge_type string, passed_on string"
WANTED = "target_path string, file_path string, passes_on boolean"
#: A term of a chunk, and a chunk whose terms of segments before this one are dead.
POSTINGS = "tok string, id string, tf bigint, doc_len int, segment bigint"
DEAD_TERMS = "id string, segment bigint"
TRIGRAMS = "tri string, id string, segment bigint"
TABLES = {
    "chunks": CHUNKS, "vectors": VECTORS, "edges": EDGES, "scan_cache": SCAN_CACHE, "sessions": SESSIONS, "turns": TURNS,
    "ledger": LEDGER, "fingerprint": FINGERPRINT, "edges_in": EDGES, "references": REFERENCES, "wanted": WANTED,
    "postings": POSTINGS, "trigrams": TRIGRAMS, "dead_terms": DEAD_TERMS,
}

#: Fixed value: the content of the turn that tells a session that it is put to rest.
IDLE_NOTICE = '{"kind":"reaper_notice","text":"Session moved to idle after inactivity."}'
