"""Explicit schemas of the tables the jobs exchange."""

from __future__ import annotations

YEARLY_COUNTS = "ARRAY<STRUCT<year: INT, works_count: BIGINT, cited_by_count: BIGINT>>"

FEED = (
    "entry ARRAY<STRUCT<id: STRING, title: STRING, summary: STRING, published: STRING, updated: STRING, "
    "author: ARRAY<STRUCT<name: STRING>>, category: ARRAY<STRUCT<_term: STRING>>>>"
)

FEED_ENTRY = (
    "id STRING, title STRING, summary STRING, published STRING, updated STRING, "
    "author ARRAY<STRUCT<name: STRING>>, category ARRAY<STRUCT<_term: STRING>>"
)

WORK_RESPONSE = f"results ARRAY<STRUCT<id: STRING, counts_by_year: {YEARLY_COUNTS}>>"

DATASET = (
    "paper_id STRING, title STRING, abstract STRING, categories ARRAY<STRING>, authors ARRAY<STRING>, "
    "published TIMESTAMP_NTZ, work_id STRING, y12 BIGINT, n_authors INT, primary_cat STRING, month INT, pub_year INT"
)

CACHE = "namespace STRING, key STRING, payload STRING, fetched_at TIMESTAMP_NTZ"

SUBSCRIPTION_EVENT = "email STRING, action STRING, at TIMESTAMP_NTZ, seq BIGINT"
