"""Retrieval metrics against graded gold evidence, and generation metrics against citations and gold claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import CITATION, base_path, citation_tags, claims

KEY = ["sample_id", "document_id", "base_path", "page_start", "page_end"]
CUTOFFS = (1, 5, 10)


def graded(results: DataFrame, gold: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(sample_id, rank, relevance), and the columns `carry`, of each result: the highest grade of gold evidence with its document, path without part suffix and pages; 0 without."""
    keyed = lambda rows: rows.withColumn("base_path", base_path("structural_path"))
    best = keyed(gold).groupBy(*KEY).agg(F.max("relevance").alias("relevance"))
    return keyed(results).join(best, KEY, "left").select("sample_id", *carry, "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"))


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1


def per_sample(samples: DataFrame, results: DataFrame, gold: DataFrame, stages: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank, hit rate and nDCG at the cutoffs, precision and recall at 5, of each sample that counts; 0 without results.

    Precision divides by 5 however few results there are; recall can exceed 1 where parts of one gold item are all found. With `stages` the results
    have a column `stage`, and each sample has a row for each of them; results and gold are still read once.
    """
    rank, rel = F.col("rank"), F.col("relevance")
    by = ["stage", "sample_id"] if stages else ["sample_id"]
    found = graded(results, gold, by[:-1]).groupBy(*by).agg(
        *[F.min(F.when((rel > 0) & (rank <= k), rank)).alias(f"_first_{k}") for k in CUTOFFS],
        *[F.sum(F.when(rank <= k, _gain(rel) / F.log2(rank + 1))).alias(f"_dcg_{k}") for k in CUTOFFS],
        F.sum(F.when((rel > 0) & (rank <= 5), 1).otherwise(0)).alias("_matched"),
    )
    ordered = gold.withColumn("_place", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("relevance").desc())))
    ideal = ordered.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_gold"), *[F.sum(F.when(F.col("_place") <= k, _gain(rel) / F.log2(F.col("_place") + 1))).alias(f"_ideal_{k}") for k in CUTOFFS])
    # A sample without gold has no ideal, and does not count.
    counting = samples.filter("query_type = 'in_domain'").select("sample_id").join(ideal, "sample_id")
    if stages:
        counting = counting.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    rows = counting.join(found, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ndcg = lambda k: F.when(F.col(f"_ideal_{k}") > 0, F.least(F.lit(1.0), zero(F.col(f"_dcg_{k}")) / F.col(f"_ideal_{k}"))).otherwise(0.0)
    return rows.select(
        *by, *[zero(1.0 / F.col(f"_first_{k}")).alias(f"rr_{k}") for k in CUTOFFS], *[F.col(f"_first_{k}").isNotNull().cast("double").alias(f"hit_{k}") for k in CUTOFFS],
        *[ndcg(k).alias(f"ndcg_{k}") for k in CUTOFFS], (zero(F.col("_matched").cast("double")) / 5.0).alias("precision_5"), (zero(F.col("_matched").cast("double")) / F.col("_gold")).alias("recall_5"),
    )


def _means(names: Sequence[str]) -> list[Column]:
    """Means to 4 places. They are rounded to 9 first: their last bits hang on the order of the sum, and would decide where a mean lies half-way."""
    return [F.count(F.lit(1)).alias("n_samples"), *[F.coalesce(F.round(F.round(F.avg(n), 9), 4), F.lit(0.0)).alias(n) for n in names]]


def stage_summaries(metrics: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One row for each stage of metrics that have a column `stage`: how many samples count and the mean of each metric; zeros if none count."""
    names = [c for c in metrics.columns if c not in ("stage", "sample_id")]
    all_stages = metrics.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    found = all_stages.join(metrics.groupBy("stage").agg(*_means(names)), "stage", "left")
    return found.select("stage", F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def order_means(rows: DataFrame, wanted: DataFrame, stages: Mapping[str, str], k: int = 10) -> DataFrame:
    """One row for each stage, by the column that holds its rank: how many queries there are, and their mean reciprocal rank and nDCG at k.

    rows (query_id, right, a rank of each stage); wanted (query_id, wanted): the queries that count and how many right rows there are in all. Queries
    without any found count as 0, and no queries at all give zeros.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(rank).cast("int").alias("place")) for name, rank in stages.items()]))
    lists = rows.filter("right").select("query_id", each.alias("_s")).select("query_id", "_s.stage", "_s.place").filter(F.col("place") <= k)
    found = lists.groupBy("stage", "query_id").agg(F.min("place").alias("_first"), F.sum(1 / F.log2(F.col("place") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    counting = wanted.select("query_id", ideal.alias("_ideal")).withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    each_query = counting.join(found, ["stage", "query_id"], "left")
    metrics = each_query.select("stage", F.col("query_id").alias("sample_id"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias(f"rr_{k}"), F.coalesce(F.col("_dcg") / F.col("_ideal"), F.lit(0.0)).alias(f"ndcg_{k}"))
    return stage_summaries(metrics, list(stages))


def stage_summary(metrics: DataFrame, stage: str) -> DataFrame:
    """One row: how many samples count and the mean of each metric to 4 places; zeros if none count."""
    names = [c for c in metrics.columns if c != "sample_id"]
    return metrics.agg(*_means(names)).select(F.lit(stage).alias("stage"), "*")


def _cites(cited: DataFrame, evidence: DataFrame) -> Column:
    """Whether a citation names the evidence: what the citation lacks is not compared."""
    return (
        (cited["key"] == evidence["key"])
        & (cited["cited_path"] == evidence["gold_path"])
        & (cited["page_start"].isNull() | cited["page_end"].isNull() | (cited["page_start"] == evidence["gold_start"]) & (cited["page_end"] == evidence["gold_end"]))
        & (cited["document_id"].isNull() | (cited["document_id"] == evidence["gold_document"]))
    )


def generation(samples: DataFrame, citations: DataFrame, gold: DataFrame, gold_claims: DataFrame) -> DataFrame:
    """One row of grounding metrics.

    samples (key, answer, abstained, expected_abstain or null); citations (key, context_id, document_id, structural_path, page_start, page_end),
    each valid tag once; gold and gold_claims (key[, claim_id], document_id, structural_path, page_start, page_end). Abstained samples count for
    abstention only. Empty denominators give 1, no samples at all 0.
    """
    spoke = samples.filter("not abstained")
    live = lambda rows: rows.join(spoke.select("key"), "key", "left_semi")
    cited = live(citations).select("key", "context_id", "document_id", base_path("structural_path").alias("cited_path"), "page_start", "page_end")
    named = lambda rows, *more: live(rows).select("key", *more, F.col("document_id").alias("gold_document"), base_path("structural_path").alias("gold_path"), F.col("page_start").alias("gold_start"), F.col("page_end").alias("gold_end"))
    evidence, needed = named(gold), named(gold_claims, "claim_id")
    tags, pieces = citation_tags("answer"), claims("answer")
    base = samples.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("abstained") == F.coalesce("expected_abstain", F.lit(False))).cast("long")), F.lit(0)).alias("right"))
    said = spoke.agg(F.coalesce(F.sum(F.size(tags)), F.lit(0)).alias("tags"), F.coalesce(F.sum(F.size(pieces)), F.lit(0)).alias("claims"), F.coalesce(F.sum(F.size(F.filter(pieces, lambda c: F.regexp_like(c, F.lit(CITATION))))), F.lit(0)).alias("grounded"))
    made = cited.agg(F.count(F.lit(1)).alias("made"))
    matched = cited.join(evidence, _cites(cited, evidence), "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    wanted = evidence.agg(F.count(F.lit(1)).alias("wanted"))
    covered = needed.withColumn("_row", F.monotonically_increasing_id())
    hit = covered.join(cited, _cites(cited, covered), "left_semi").select("_row", F.lit(True).alias("_hit"))
    whole = covered.join(hit, "_row", "left").groupBy("key", "claim_id").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("ok")).agg(F.count(F.lit(1)).alias("gold_claims"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("covered"))
    row = base
    for part in (said, made, matched, wanted, whole):
        row = row.join(F.broadcast(part))  # one row each
    share = lambda a, b: F.when(F.col("n") == 0, 0.0).otherwise(F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(1.0))
    return row.select(
        F.col("n").alias("total_samples"), share("made", "tags").alias("citation_validity"), share("matched", "made").alias("citation_precision"), share("matched", "wanted").alias("citation_recall"), share("grounded", "claims").alias("grounding_coverage"),
        share("covered", "gold_claims").alias("gold_claim_coverage"), F.when(F.col("n") == 0, 0.0).otherwise(F.round(1 - F.when(F.col("claims") > 0, F.col("grounded") / F.col("claims")).otherwise(1.0), 4)).alias("unsupported_claim_rate"), share("right", "n").alias("abstention_accuracy"),
    )
