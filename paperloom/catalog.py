"""The registry with every query of the library in it."""

from paperloom.plans import assessment, boundary, chunks, generation, relational, retrieval, text, topics
from paperloom.registry import ORACLES, QUERIES

MODULES = (assessment, boundary, chunks, generation, relational, retrieval, text, topics)
#: SQL types that would otherwise differ from those of the queries (decimals and wide sums).
CASTS = {
    "DOUBLE": {"score": ("validate_distractors", "validate_grounding", "validate_grounding_batch", "persist_correctness", "map_lookup"), "confidence": ("agg_confidence", "pdf_outline_topics")},
    "BIGINT": {
        "correct_count": ("validate_distractors",), "char_start": ("src_page_offsets",), "char_end": ("src_page_offsets",),
        "changed": ("backfill_classes",), "skipped": ("backfill_classes",), "n": ("agg_excluded_count",), "chars": ("sink_chunks",), "draft": ("agg_status_counts",), "reviewed": ("agg_status_counts",),
        "approved": ("agg_status_counts",), "rejected": ("agg_status_counts",), "n_blacklist": ("diversity_context",), "start": ("build_chunks",), "stop": ("build_chunks",), "start_char": ("chunk_document",),
        "end_char": ("chunk_document",), "fl": ("math_scalars",), "ce": ("math_scalars",),
    },
}
for _kind, _columns in CASTS.items():
    for _column, _names in _columns.items():
        for _name in _names:
            ORACLES[_name] = f'SELECT * REPLACE ("{_column}"::{_kind} AS "{_column}") FROM ({ORACLES[_name]})'

__all__ = ["MODULES", "ORACLES", "QUERIES"]
