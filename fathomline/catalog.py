"""Registry of the queries outside the llm subpackage, each with its DuckDB statement where SQL has one."""

from __future__ import annotations

from fathomline.plans import curation, documents, evaluation, grounding, logs, parsing, review, search, structure

PARTS = (search, documents, evaluation, logs, parsing, curation, grounding, structure, review)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
