"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from lexloom.plans import evaluation, ingestion, retrieval, structure

QUERIES: dict = {**retrieval.QUERIES, **structure.QUERIES, **evaluation.QUERIES, **ingestion.QUERIES}
ORACLES: dict[str, str] = {**retrieval.ORACLES, **structure.ORACLES, **evaluation.ORACLES, **ingestion.ORACLES}
