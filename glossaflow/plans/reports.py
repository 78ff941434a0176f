"""Evaluation reports: one pass over the rows, one small exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import scores as S
from glossaflow.functions import text as X
from glossaflow.operators import metrics as M
from glossaflow.operators import rows as O
from glossaflow.patterns import BLEU_ORDER


def entity_report(results: DataFrame, *by: str) -> DataFrame:
    """Counts, entity accuracy and retention, and BLEU of prediction rows.

    Texts of invalid rows are nulled rather than filtered, so the same pass also
    counts them. The neural score column is kept for its readers and stays null.
    """
    valid = O.is_valid()
    masked = results.select(
        *by, valid.alias("_valid"),
        F.when(valid, F.col("prediction")).alias("prediction"),
        F.when(valid, F.col("reference")).alias("reference"),
    )
    stats = M.with_entities(M.with_stats(masked, order=BLEU_ORDER, tokens=False))
    sums = stats.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("_valid").alias("valid"),
        *M.ngram_sums(BLEU_ORDER), *M.entity_rates(),
    )
    return sums.select(
        *by, "total", "valid", M.eta_column(), M.err_column(),
        S.bleu_text(S.bleu_from()).alias("BLEU"),
        F.lit(None).cast("double").alias("COMET"),
    )


def _intrinsic(pairs: DataFrame, count: str, *by: str, pred: str, ref: str) -> DataFrame:
    sums = M.with_stats(pairs, pred, ref).groupBy(*by).agg(
        F.count("*").alias(count), *M.ngram_sums(), *M.token_rates()
    )
    return sums.select(*by, count, M.chrf_column(), *M.rate_columns())


def intrinsic_report(results: DataFrame, *by: str, source: str | None = None) -> DataFrame:
    """chrF, hallucination rate and content coverage of prediction rows.

    ``source`` names the input in a column ``input``.
    """
    valid = O.valid_predictions(results)
    report = _intrinsic(valid, "valid", *by, pred="prediction", ref="reference")
    return report if source is None else report.select(F.lit(source).alias("input"), "*")


def system_report(
    rows: DataFrame,
    prediction: Sequence[str] = ("pred_zh", "pred"),
    reference: Sequence[str] = ("ref_zh", "ref"),
    by: str = "model",
) -> DataFrame:
    """One report row per system over merged files of any field convention.

    Without any valid pair there is nothing to report, which is an error. Rows that
    carry their ``file`` also get the system's sorted list of files, in the same pass; a
    system without pairs then stays, with no samples and null scores.
    """
    pairs = O.require_rows(O.coalesced_pairs(rows, prediction, reference), "no valid pairs")
    if "file" not in rows.columns:
        return _intrinsic(pairs, "samples", by, pred="pred", ref="ref")
    filled = O.is_filled(prediction, reference)
    side = lambda names: F.when(filled, X.coalesce_fields(*[F.col(c) for c in names]))
    masked = rows.select(by, "file", filled.alias("_valid"), side(prediction).alias("_pred"), side(reference).alias("_ref"))
    sums = M.with_stats(masked, "_pred", "_ref").groupBy(by).agg(
        F.count_if("_valid").alias("samples"), F.array_sort(F.collect_set("file")).alias("files"),
        *M.ngram_sums(), *M.token_rates(),
    )
    scored = F.when(F.col("samples") > 0, M.chrf_column()).alias("chrF")
    return sums.select(by, "samples", scored, *M.rate_columns(), "files")
