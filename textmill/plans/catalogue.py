"""Imports every module of queries."""

from textmill.plans import (  # noqa: F401
    annotation_queries,
    answer_queries,
    article_queries,
    chain_queries,
    curriculum_queries,
    extract_queries,
    label_queries,
    place_queries,
    quality_queries,
    rollup_queries,
    score_queries,
    source_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
