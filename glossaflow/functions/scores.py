"""Score formulas on corpus sums."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.patterns import BLEU_FORMAT, BLEU_ORDER, CHRF_BETA, CHRF_ORDER


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def _total(parts) -> Column:
    return reduce(add, parts)


def chrf_score(hyp, ref, match, beta: float = CHRF_BETA) -> Column:
    """chrF from corpus sums per order (Popovic 2015), in percent.

    ``hyp`` must already leave out n-grams of orders a row's reference lacks.
    Precision and recall are averaged over the orders both sides have.
    """
    used = [(h > 0) & (r > 0) for h, r in zip(hyp, ref)]
    orders = _total(u.cast("int") for u in used)

    def mean(tops, bottoms) -> Column:
        parts = [
            F.when(u, t / b).otherwise(F.lit(0.0))
            for u, t, b in zip(used, tops, bottoms)
        ]
        return _total(parts) / orders

    precision, recall = mean(match, hyp), mean(match, ref)
    f = F.lit(beta * beta)
    score = (f + 1) * precision * recall / (f * precision + recall) * 100
    return F.when((orders > 0) & (_total(match) > 0), score).otherwise(F.lit(0.0))


def bleu_terms(hyp, ref, match) -> dict[str, Column]:
    """Corpus BLEU and its terms (Papineni 2002) from sums per order.

    The k-th order without a match gets 100 / (2^k total) as its precision
    (Post 2018). Without any match at all every precision is zero.
    """
    hyp_len, ref_len = hyp[0], ref[0]
    some = _total(match) > 0
    precisions, misses = [], F.lit(0)
    for h, m in zip(hyp, match):
        misses = misses + F.when((h > 0) & (m == 0), 1).otherwise(0)
        smooth = F.lit(100.0) / (F.pow(F.lit(2.0), misses) * h)
        precisions.append(
            F.when(~some | (h == 0), F.lit(0.0))
            .when(m == 0, smooth)
            .otherwise(m * 100.0 / h)
        )
    penalty = (
        F.when(hyp_len >= ref_len, F.lit(1.0))
        .when(hyp_len > 0, F.exp(1 - ref_len / hyp_len))
        .otherwise(F.lit(0.0))
    )
    complete = reduce(lambda a, b: a & b, [p > 0 for p in precisions])
    log_mean = _total(F.log(p) for p in precisions) / len(precisions)
    return {
        "score": F.when(complete, penalty * F.exp(log_mean)).otherwise(F.lit(0.0)),
        "precisions": precisions,
        "penalty": penalty,
        "ratio": F.coalesce(_ratio(hyp_len, ref_len), F.lit(0.0)),
        "hyp_len": hyp_len,
        "ref_len": ref_len,
    }


def fixed(x: Column, places: int) -> Column:
    """``x`` with ``places`` decimals; ties go by the exact binary value, to even.

    ``format_string`` rounds the shortest decimal form half up instead.
    """
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def bleu_text(terms: dict[str, Column]) -> Column:
    """One-line printed form of a corpus BLEU score."""
    return F.format_string(
        BLEU_FORMAT,
        fixed(terms["score"], 2), *[fixed(p, 1) for p in terms["precisions"]],
        fixed(terms["penalty"], 3), fixed(terms["ratio"], 3), terms["hyp_len"], terms["ref_len"],
    )


def sums_of(prefix: str, kind: str, order: int) -> list[Column]:
    """Columns ``{prefix}{kind}1..order``."""
    return [F.col(f"{prefix}{kind}{n}") for n in range(1, order + 1)]


def bleu_from(prefix: str = "") -> dict[str, Column]:
    """BLEU terms of the sum columns h/r/m."""
    return bleu_terms(*[sums_of(prefix, k, BLEU_ORDER) for k in "hrm"])


def chrf_from(prefix: str = "", beta: float = CHRF_BETA) -> Column:
    """chrF of the sum columns c (usable hypothesis grams), r and m."""
    return chrf_score(*[sums_of(prefix, k, CHRF_ORDER) for k in "crm"], beta=beta)
