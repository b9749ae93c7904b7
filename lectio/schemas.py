"""Schemas of the engine's tables."""

from __future__ import annotations

DOCS = "doc_id string, title string, url string, path string, content_type string, content string, last_indexed_at timestamp"
POSTINGS = "term string, doc_id string, tf int, positions array<int>, doc_len int"
LENGTHS = "doc_id string, doc_len int"
STATS = "n long, avgdl double"
ITEMS = "rank int, title string, url string, snippet string, score double, source_type string, is_scholarly boolean, domain string"
CRAWLED = "page_id long, url string, title string, text_content string, out_links array<string>, success boolean, error string, crawled_at timestamp"
