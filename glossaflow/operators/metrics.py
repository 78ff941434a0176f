"""Row statistics and the corpus metrics that are sums of them.

Every metric is a formula on sums, so any number of metrics over any number of
systems takes one pass: a row-local stage, partial sums, and one exchange of a
few numbers per system. A system holding most rows is combined before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow import patterns as P
from glossaflow.functions import scores as S
from glossaflow.functions import text as X
from glossaflow.functions.pair_stats import TOKEN_FIELDS, pair_stats
from glossaflow.functions.retention import retained
from glossaflow.operators.rows import is_valid


# -- per row ------------------------------------------------------------------

def with_stats(
    df: DataFrame,
    pred: str = "prediction",
    ref: str = "reference",
    order: int = P.CHRF_ORDER,
    tokens: bool = True,
) -> DataFrame:
    """Add the match count struct ``st``: character n-grams up to ``order``, tokens.

    Order 0 leaves n-grams out.
    """
    return df.withColumn("st", pair_stats(F.col(pred), F.col(ref), order, tokens))


def with_entities(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Add ``n_entities`` of the reference and ``n_retained`` by the prediction."""
    return (
        df.withColumn("_e", X.entities(F.col(ref)))
        .withColumns({
            "n_entities": F.size("_e").cast("bigint"),
            "n_retained": retained(F.col("_e"), F.col(pred)),
        })
        .drop("_e")
    )


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Token multiset per row as ``(key, token, n)``."""
    tokens = df.select(key, F.explode(X.tokenize_mixed(F.col(text))).alias("token"))
    return tokens.groupBy(key, "token").agg(F.count("*").alias("n"))


def token_overlap_relational(
    df: DataFrame, key: str, pred: str = "prediction", ref: str = "reference"
) -> DataFrame:
    """Token overlap as explode and group-by; needs a unique ``key``.

    Same result as the token counts of :func:`with_stats` for rows with tokens
    on both sides. Use it where tokens are already exploded and partitioned by
    ``key``; otherwise it shuffles what :func:`with_stats` leaves in place.
    """
    def side(text: str, p: int, r: int) -> DataFrame:
        tokens = F.explode(X.tokenize_mixed(F.col(text))).alias("token")
        return df.select(key, tokens).select(
            key, "token", F.lit(p).alias("p"), F.lit(r).alias("r")
        )

    per_token = (
        side(pred, 1, 0).unionAll(side(ref, 0, 1))
        .repartition(key)
        .groupBy(key, "token").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    )
    return (
        per_token.groupBy(key).agg(
            F.sum("p").alias("pred_tokens"),
            F.sum("r").alias("ref_tokens"),
            F.sum(F.least("p", "r")).alias("matched"),
        ).filter((F.col("pred_tokens") > 0) & (F.col("ref_tokens") > 0))
    )


# -- corpus sums --------------------------------------------------------------

def ngram_sums(order: int = P.CHRF_ORDER) -> list[Column]:
    """h/r/m sums per order, and c: hypothesis grams where the reference has any."""
    out = []
    for n in range(1, order + 1):
        h, r, m = (F.col(f"st.{k}{n}") for k in "hrm")
        out += [
            F.sum(h).alias(f"h{n}"), F.sum(r).alias(f"r{n}"), F.sum(m).alias(f"m{n}"),
            F.sum(F.when(r > 0, h).otherwise(0)).alias(f"c{n}"),
        ]
    return out


def token_rates() -> list[Column]:
    """Mean unsupported share and covered share; rows short of tokens left out."""
    p, r, matched = (F.col(f"st.{name}") for name in TOKEN_FIELDS)
    both = (p > 0) & (r > 0)
    return [
        F.count_if(both).alias("scored"),
        F.avg(F.when(both, 1 - matched / p)).alias("_hall"),
        F.avg(F.when(both, matched / r)).alias("_cov"),
    ]


def entity_rates() -> list[Column]:
    """Entity totals and the mean retained share of rows that have entities."""
    some = F.col("n_entities") > 0
    return [
        F.coalesce(F.sum("n_entities"), F.lit(0)).alias("total_entities"),
        F.coalesce(F.sum("n_retained"), F.lit(0)).alias("retained_entities"),
        F.avg(F.when(some, F.col("n_retained") / F.col("n_entities"))).alias("_err"),
    ]


# -- final columns, on the sums ----------------------------------------------

def percent(c: Column, places: int = 4) -> Column:
    """Share as a rounded percentage."""
    return F.round(c * 100, places)


def chrf_column(beta: float = P.CHRF_BETA) -> Column:
    """Rounded corpus chrF."""
    return F.round(S.chrf_from(beta=beta), 4).alias("chrF")


def rate_columns() -> list[Column]:
    """Rounded hallucination rate and content coverage; null without rows."""
    return [
        percent(F.col("_hall")).alias("hallucination_rate"),
        percent(F.col("_cov")).alias("content_coverage"),
    ]


def eta_column() -> Column:
    """Rounded share of all entities retained; 0 without entities."""
    share = F.when(
        F.col("total_entities") > 0, F.col("retained_entities") / F.col("total_entities")
    )
    return F.coalesce(percent(share), F.lit(0.0)).alias("ETA")


def err_column() -> Column:
    """Rounded mean retained share; 0 without entities."""
    return F.coalesce(percent(F.col("_err")), F.lit(0.0)).alias("ERR")


# -- metrics ------------------------------------------------------------------

def corpus_chrf(valid: DataFrame, *by: str, beta: float = P.CHRF_BETA) -> DataFrame:
    """Corpus chrF per group."""
    sums = with_stats(valid, tokens=False).groupBy(*by).agg(*ngram_sums())
    return sums.select(*by, chrf_column(beta))


def corpus_bleu(valid: DataFrame, *by: str) -> DataFrame:
    """Corpus BLEU per group over character tokens: score, terms, printed form."""
    stats = with_stats(valid, order=P.BLEU_ORDER, tokens=False)
    sums = stats.groupBy(*by).agg(*ngram_sums(P.BLEU_ORDER))
    terms = S.bleu_from()
    return sums.select(
        *by,
        F.round(terms["score"], 4).alias("bleu"),
        F.round(terms["penalty"], 4).alias("brevity_penalty"),
        terms["hyp_len"].alias("hyp_len"),
        terms["ref_len"].alias("ref_len"),
        S.bleu_text(terms).alias("bleu_text"),
    )


def hallucination_coverage(valid: DataFrame, *by: str) -> DataFrame:
    """Hallucination rate and content coverage per group."""
    sums = with_stats(valid, order=0).groupBy(*by).agg(*token_rates())
    return sums.select(*by, "scored", *rate_columns())


def entity_accuracy(valid: DataFrame, *by: str) -> DataFrame:
    """Share of all reference entities found in the predictions."""
    sums = with_entities(valid).groupBy(*by).agg(*entity_rates())
    return sums.select(*by, "total_entities", "retained_entities", eta_column())


def entity_retention(valid: DataFrame, *by: str) -> DataFrame:
    """Mean share of a row's reference entities found in its prediction."""
    sums = with_entities(valid).groupBy(*by).agg(*entity_rates())
    return sums.select(*by, err_column())


# -- run figures --------------------------------------------------------------

def run_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in total, rows that ended well, rows valid for scoring."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == P.STATUS_OK).alias("ok"),
        F.count_if(is_valid()).alias("valid"),
    )


def latency_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Mean, least and greatest latency of rows that ended well; total minutes.

    Latencies have three places, so decimal sums are exact in any row order.
    """
    exact = F.col("latency_s").cast("decimal(18,3)")
    ok = F.when(F.col("status") == P.STATUS_OK, exact)
    seconds = F.sum(ok).cast("double")
    return rows.groupBy(*by).agg(
        F.count(ok).alias("ok"),
        F.round(seconds / F.count(ok), 4).alias("mean_s"),
        F.min(ok).cast("double").alias("min_s"),
        F.max(ok).cast("double").alias("max_s"),
        F.round(F.sum(exact).cast("double") / 60, 4).alias("total_min"),
    )


def status_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows per outcome, messages left off."""
    kind = F.split_part("status", F.lit(":"), F.lit(1)).alias("outcome")
    return rows.groupBy(*by, kind).agg(F.count("*").alias("n"))
