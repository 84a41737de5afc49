"""Evaluation datasets as JSON, and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.storage import write_files

_EVIDENCE = "struct<document_id: string, structural_path: string, page_start: int, page_end: int, relevance: int>"
SCHEMA = f"dataset_version string, corpus_scope array<string>, samples array<struct<sample_id: string, query: string, query_type: string, canonical_ground_truth: array<{_EVIDENCE}>, gold_generation: struct<expected_abstain: boolean, expected_claims: array<struct<claim_id: string, claim_description: string, supporting_evidence: array<{_EVIDENCE}>>>>>>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample. A missing file raises FileNotFoundError; invalid JSON, no samples or a relevance outside 0..3 ValueError."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    try:
        rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).select("dataset_version", F.explode("samples").alias("s")).select("dataset_version", "s.*")
        n = rows.count()
    except Exception as e:
        raise ValueError(f"{path} is no evaluation dataset: {str(e)[:200]}") from e
    if not n:
        raise ValueError(f"{path} has no samples")
    if gold(rows).filter("relevance not between 0 and 3").limit(1).count():
        raise ValueError(f"{path} has a relevance outside 0 to 3")
    return rows


def gold(samples: DataFrame) -> DataFrame:
    """(sample_id, document_id, structural_path, page_start, page_end, relevance): evidence without a grade counts 3."""
    return samples.select("sample_id", F.explode("canonical_ground_truth").alias("e")).select("sample_id", "e.document_id", "e.structural_path", "e.page_start", "e.page_end", F.coalesce("e.relevance", F.lit(3)).alias("relevance"))


def gold_claims(samples: DataFrame) -> DataFrame:
    """(sample_id, claim_id, document_id, structural_path, page_start, page_end) of each claim's evidence."""
    each = samples.select("sample_id", F.explode("gold_generation.expected_claims").alias("c"))
    return each.select("sample_id", "c.claim_id", F.explode("c.supporting_evidence").alias("e")).select("sample_id", "claim_id", "e.document_id", "e.structural_path", "e.page_start", "e.page_end")


def _write(spark: SparkSession, files: dict[str, str]) -> None:
    """Whole files at their addresses, on any file system that tasks can open; a plain path is one of this machine."""
    address = lambda path: path if "://" in path else Path(path).absolute().as_uri()
    write_files(spark.createDataFrame([(address(p), text) for p, text in files.items()], "path string, content string")).collect()


def save(samples: DataFrame, path: str, version: str, scope: list[str]) -> None:
    """One JSON file; a gold dataset is small by nature."""
    rows = [r.asDict(recursive=True) for r in samples.drop("dataset_version").collect()]
    _write(samples.sparkSession, {path: json.dumps({"dataset_version": version, "corpus_scope": scope, "samples": rows}, ensure_ascii=False, indent=2)})


#: Columns of a report's stage table, with their heads.
STAGE_TABLE = (("rr_1", "MRR@1 (=HitRate@1)"), ("rr_5", "MRR@5"), ("rr_10", "MRR@10"), ("hit_5", "HitRate@5"), ("hit_10", "HitRate@10"), ("ndcg_5", "nDCG@5"), ("ndcg_10", "nDCG@10"), ("precision_5", "Precision@5"), ("recall_5", "Recall@5"))


def export(stages: DataFrame, generation: DataFrame | None, folder: str, version: str = "", samples: int | None = None) -> None:
    """report.json and report.md: a row for each retrieval stage, in the order they come, and the generation metrics as shares.

    stages: as of evaluate.stage_summary; a handful of rows.
    """
    rows = [r.asDict() for r in stages.collect()]
    spoken = generation.first().asDict() if generation is not None else None
    total = samples if samples is not None else max((r["n_samples"] for r in rows), default=0)
    whole = json.dumps({"dataset_version": version, "total_samples": total, "retrieval": rows, "generation": spoken}, indent=2)
    lines = ["# Evaluation", "", f"- Dataset version: `{version}`", f"- Samples: `{total}`", "", "## 1. Retrieval by stage", "", "| Stage | " + " | ".join(h for _, h in STAGE_TABLE) + " |", "|---" * (len(STAGE_TABLE) + 1) + "|"]
    lines += [f"| {r['stage']} | " + " | ".join(f"{r[n]:.4f}" for n, _ in STAGE_TABLE) + " |" for r in rows]
    lines += ["", "## 2. Generation", ""]
    lines += [f"- {k.replace('_', ' ').capitalize()}: `{v * 100:.2f} %`" for k, v in spoken.items() if isinstance(v, float)] if spoken else ["None was measured."]
    _write(stages.sparkSession, {f"{folder}/report.json": whole, f"{folder}/report.md": "\n".join(lines) + "\n"})
