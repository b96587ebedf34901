"""All registered queries and their SQL."""

from __future__ import annotations

from policyloom.workload import chat, evaluation, ingestion, judging, retrieval, verification

_MODULES = (ingestion, retrieval, verification, judging, evaluation, chat)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
