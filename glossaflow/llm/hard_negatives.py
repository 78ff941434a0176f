"""Hard negatives: exact integer scores in a residue number system, then windows.

Every component ``x`` becomes the integer ``floor(256 * x)``. A score is the inner
product of two such vectors. It is computed modulo several small primes: residues lie
around zero and dimensions are summed in runs short enough that a float32 matrix
product is exact. Mixed-radix digits around zero then give back the signed score
(Chinese remainders); there are as many primes as the longest vector's square needs.

The anchors are a stated query set against all rows, in blocks: a cell is one block of
anchors and one stripe of rows, streamed through it. A first pass finds each anchor's
nearest rows of its label, a second one, per such positive, the best rows of other
labels inside its window of scores. Cells hand over a bounded number of rows per
anchor, and windows over those make the selection.

Defined results: rows with a null label, vector or component, or one that is not
finite, take no part; repeated rows are rows of their own, and a repeated anchor gives
its results once more; a null ``vec_id`` is no anchor and stands behind all others of
equal score; of vectors of unlike length the shorter one counts as filled up with zeros;
labels and ids may be negative. Scores that a 64-bit integer may not hold (vectors
whose sum of squares reaches 2**62) stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.llm.tables import keep

SCALE, EVERY, MOVED_EVERY, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
STRIPE_ROWS, LEAST_STRIPE_ROWS = 1 << 20, 1 << 13
ANCHOR_BYTES, TILE = 64 << 20, 1 << 21

#: Sums below this are exact in float32, and so is their quotient's nearest integer.
_EXACT = 1 << 20
_LEAST = np.iinfo(np.int64).min

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def moduli(bound: int, below: int = 256) -> list[int]:
    """The largest primes under ``below`` whose product holds scores up to ``bound`` of either sign."""
    out, product = [], 1
    for p in range(below - 1, 2, -1):
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
            if product > 2 * bound:
                return out
    raise ValueError("no primes left")


def _near_zero(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p``, as a float32 integer from ``-(p // 2)`` to ``p // 2``."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(parts: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Integer vectors (rows) modulo each prime."""
    out = []
    for p in primes:
        r = parts % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b`` from their residues."""
    total, radix, digits = None, 1, []
    for p, x, y in zip(primes, a, b):
        run = max(1, _EXACT // (p // 2) ** 2)
        rest = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, x.shape[1], run):
            rest = _near_zero(rest + _near_zero(x[:, at:at + run] @ y[:, at:at + run].T, p), p)
        # The next digit is what the earlier ones leave, divided by their radix, modulo p.
        weight = 1
        for q, digit in zip(primes, digits):
            rest = _near_zero(rest - np.float32((weight + p // 2) % p - p // 2) * digit, p)
            weight = weight * q % p
        inverse = pow(radix, -1, p)
        digit = _near_zero(rest * np.float32(inverse - p * (inverse > p // 2)), p)
        digits.append(digit)
        part = digit.astype(np.int64) * radix
        total = part if total is None else total + part
        radix *= p
    return total


class Tops:
    """The best ``k`` entries of each of ``n`` lists: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _LEAST)
        self.id, self.null = np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Offer entries ``(list, score, id, whether the id is null)``."""
        if not len(at):
            return
        k, lists = self.score.shape[1], np.unique(at)
        old = np.repeat(lists, k)
        at = np.concatenate((old, at))
        score = np.concatenate((self.score[lists].ravel(), score))
        ids = np.concatenate((self.id[lists].ravel(), ids))
        null = np.concatenate((self.null[lists].ravel(), null))
        order = np.lexsort((ids, null, ~score, at))
        first = np.searchsorted(at[order], lists)
        taken = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[lists], self.id[lists], self.null[lists] = (
            x[taken].reshape(-1, k) for x in (score, ids, null)
        )

    @property
    def bar(self) -> np.ndarray:
        """The score an entry needs to enter each list."""
        return self.score[:, -1]

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """``(list, place, id, score)`` of all entries."""
        at, place = np.nonzero(self.score > _LEAST)
        return at, place, pa.array(self.id[at, place], pa.int64(), mask=self.null[at, place]), self.score[at, place]


class _Side:
    """Rows of one Arrow batch, or the anchors of a cell."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, primes: list[int], dims: int):
        column = {n: batch.column(n) for n in ("rid", "vec_id", "label", "parts")}
        column = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
        lists = column["parts"]
        sizes = np.diff(lists.offsets.to_numpy())
        parts = np.zeros((len(lists), dims), np.int64)
        parts[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
        self.residues = residues(parts, primes)
        self.rid = column["rid"].to_numpy()
        self.null = column["vec_id"].is_null().to_numpy(zero_copy_only=False)
        self.id = column["vec_id"].fill_null(0).to_numpy()
        self.label = column["label"].to_numpy()

    def part(self, rows: np.ndarray | slice) -> list[np.ndarray]:
        return [r[rows] for r in self.residues]


def _tiles(n: int, width: int) -> Iterator[slice]:
    step = max(1, TILE // max(1, width))
    return (slice(k, k + step) for k in range(0, n, step))


def _same_label(anchors: _Side, rows: _Side, primes: list[int], tops: Tops) -> None:
    """Offer each anchor the other rows of its label."""
    own = np.argsort(anchors.label, kind="stable")
    other = np.argsort(rows.label, kind="stable")
    for label in np.intersect1d(anchors.label, rows.label):
        a = own[np.searchsorted(anchors.label[own], label):np.searchsorted(anchors.label[own], label, "right")]
        b = other[np.searchsorted(rows.label[other], label):np.searchsorted(rows.label[other], label, "right")]
        for tile in _tiles(len(a), len(b)):
            lists = a[tile]
            s = scores(anchors.part(lists), rows.part(b), primes)
            s[anchors.rid[lists][:, None] == rows.rid[b]] = _LEAST
            bar = tops.bar[lists]
            if len(b) > POSITIVES:
                bar = np.maximum(bar, np.partition(s, len(b) - POSITIVES, axis=1)[:, len(b) - POSITIVES])
            i, j = np.nonzero((s >= bar[:, None]) & (s > _LEAST))
            tops.add(lists[i], s[i, j], rows.id[b[j]], rows.null[b[j]])


def _other_labels(anchors: _Side, rows: _Side, low: np.ndarray, high: np.ndarray, primes: list[int], tops: Tops) -> None:
    """Offer each anchor's positives (lists ``POSITIVES * anchor + place``) the rows inside their windows."""
    for tile in _tiles(len(anchors.rid), len(rows.rid)):
        s = scores(anchors.part(tile), rows.part(slice(None)), primes)
        start, stop, _ = tile.indices(len(anchors.rid))
        bar = np.maximum(tops.bar.reshape(-1, POSITIVES)[tile], low[tile])
        near = (s >= bar.min(axis=1)[:, None]) & (s <= high[tile].max(axis=1)[:, None])
        i, j = np.nonzero(near & (anchors.label[tile][:, None] != rows.label))
        value = s[i, j]
        for place in range(POSITIVES):
            inside = (value >= bar[i, place]) & (value <= high[tile][i, place])
            at, col, v = i[inside], j[inside], value[inside]
            if len(at) > 16 * NEGATIVES * (stop - start):
                # Too many to sort: a list's best are at or above its own last place.
                grid = np.full(s.shape, _LEAST)
                grid[at, col] = v
                cut = max(0, s.shape[1] - NEGATIVES)
                best = v >= np.partition(grid, cut, axis=1)[at, cut]
                at, col, v = at[best], col[best], v[best]
            tops.add((start + at) * POSITIVES + place, v, rows.id[col], rows.null[col])


def _sides(batches: Iterator[pa.RecordBatch], primes: list[int], dims: int):
    """The anchors of a cell, once, and then its rows batch by batch."""
    held, anchors = [], None
    for batch in batches:
        rows = batch.column("is_row").to_numpy(zero_copy_only=False)
        first = int(np.searchsorted(rows, True))
        if first:
            held.append(batch.slice(0, first))
        if first < len(rows):
            if anchors is None and held:
                table = pa.Table.from_batches(held).combine_chunks()
                anchors = table, _Side(table, primes, dims)
            step = max(1, (1 << 20) // dims)
            for at in range(first, len(rows) if anchors else 0, step):
                yield *anchors, _Side(batch.slice(at, step), primes, dims)


def integer_rows(vectors: DataFrame) -> DataFrame:
    """``rid, vec_id, label, parts, squares`` of the rows that take part."""
    x, known = F.col("embedding"), F.col("label").isNotNull() & F.col("embedding").isNotNull()
    # Greater than every finite number, as Spark orders them: infinity and NaN.
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return vectors.filter(known & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        moved.alias("label"), scaled.alias("parts"),
        F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.floor(v.cast("double") * SCALE).cast("double"), F.lit(2.0))).alias("squares"),
    )


def mine(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every anchor and positive of ``vectors`` ``(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    stored, _ = keep(integer_rows(vectors), "vectors")
    anchor = F.col("vec_id") % EVERY == 0
    n, n_anchors, squares, dims = stored.agg(
        F.count("*"), F.count_if(anchor), F.max("squares"), F.max(F.size("parts"))
    ).first()
    # Vectors without components all score 0; one zero stands for them.
    dims = dims or 1
    if squares is not None and squares >= float(1 << 62):
        raise ValueError("scores of these vectors may not fit into 64 bits")
    # Rounding of the double sum is far below the factor of two kept in reserve.
    primes = moduli(2 * int(squares or 0) + 1)
    stripes = max(-(-n // STRIPE_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_STRIPE_ROWS)), 1)
    blocks = max(1, -(-n_anchors * 4 * dims * len(primes) // ANCHOR_BYTES))
    row = ("rid", "vec_id", "label", "parts")

    def cells(anchors: DataFrame, extra: dict[str, str]) -> DataFrame:
        """Anchors and rows of each cell, anchors first, one cell per partition."""
        block, stripe = F.pmod(F.xxhash64("rid"), F.lit(blocks)), F.pmod(F.xxhash64("rid"), F.lit(stripes))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_k")
        own = anchors.select(*row, *extra, F.lit(False).alias("is_row"), block.alias("_b"), every(stripes))
        all_rows = stored.select(
            *row, *[F.lit(None).cast(t).alias(c) for c, t in extra.items()], F.lit(True).alias("is_row"),
            every(blocks), stripe.alias("_s"),
        )
        both = own.withColumn("_cell", (F.col("_b") * stripes + F.col("_k")).cast("int")).unionByName(
            all_rows.withColumn("_cell", (F.col("_k") * stripes + F.col("_s")).cast("int")), allowMissingColumns=True
        )
        return (
            both.repartitionById(blocks * stripes, "_cell").sortWithinPartitions("is_row")
            .select(*row, *extra, "is_row")
        )

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tops = None
        for table, anchors, rows in _sides(batches, primes, dims):
            tops = tops or Tops(len(anchors.rid), POSITIVES)
            _same_label(anchors, rows, primes, tops)
        if tops:
            at, _, ids, score = tops.found()
            yield pa.RecordBatch.from_arrays([pa.array(anchors.rid[at]), ids, pa.array(score)], ["rid", "positive_id", "score"])

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = None
        for table, anchors, rows in _sides(batches, primes, dims):
            if tops is None:
                tops = Tops(len(anchors.rid) * POSITIVES, NEGATIVES)
                lists = table.column("positive_score").combine_chunks()
                many = np.diff(lists.offsets.to_numpy())
                score, filled = np.zeros((len(many), POSITIVES), np.int64), np.arange(POSITIVES) < many[:, None]
                score[filled] = lists.flatten().to_numpy()
                # Python's floor division rounds down on both sides of zero.
                hundreds, rest = score // 100, score % 100
                low = np.where(filled, hundreds * LOW_PERCENT - (-rest * LOW_PERCENT // 100), np.iinfo(np.int64).max)
                high = np.where(filled, hundreds * HIGH_PERCENT + rest * HIGH_PERCENT // 100, _LEAST)
            _other_labels(anchors, rows, low, high, primes, tops)
        if tops:
            at, _, ids, score = tops.found()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.rid[at // POSITIVES]), pa.array((at % POSITIVES).astype(np.int32)), ids, pa.array(score)],
                ["rid", "place", "negative_id", "negative_score"],
            )

    def best(rows: DataFrame, n: int, place: str, score: str, vec_id: str, *by: str) -> DataFrame:
        ordered = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(vec_id))
        return rows.withColumn(place, F.row_number().over(ordered)).filter(F.col(place) <= n)

    anchors = stored.filter(anchor).select(*row)
    near = cells(anchors, {}).mapInArrow(positives, "rid long, positive_id long, score long")
    near = best(near, POSITIVES, "place", "score", "positive_id", "rid")
    listed = F.array_sort(F.collect_list(F.struct("place", "positive_id", "score")))
    paired = anchors.join(near.groupBy("rid").agg(listed.alias("_p")), "rid").select(
        *row, F.col("_p.positive_id").alias("positive_id"), F.col("_p.score").alias("positive_score")
    )
    paired, _ = keep(paired, "positives")
    hard = cells(paired, {"positive_score": "array<long>"}).mapInArrow(
        negatives, "rid long, place int, negative_id long, negative_score long"
    )
    hard = best(hard, NEGATIVES, "rank", "negative_score", "negative_id", "rid", "place")
    return hard.join(paired.select("rid", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score"), "rid").select(
        "anchor_id", F.get("positive_id", "place").alias("positive_id"), "rank", "negative_id",
        F.get("positive_score", "place").alias("positive_score"), "negative_score",
    )


ORACLE_SQL = f"""
WITH taken AS (
    SELECT row_number() OVER () AS rid, vec_id, embedding,
           CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label::BIGINT END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT rid, unnest(range(len(embedding))) AS k, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM taken
), scored AS (
    SELECT a.rid AS a, b.rid AS b, sum(a.x * b.x)::BIGINT AS score
    FROM parts AS a JOIN parts AS b USING (k)
    WHERE a.rid IN (SELECT rid FROM taken WHERE vec_id % {EVERY} = 0)
    GROUP BY ALL
), pairs AS (
    SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
           coalesce(score, 0) AS score
    FROM taken AS a JOIN taken AS b ON a.rid <> b.rid LEFT JOIN scored ON scored.a = a.rid AND scored.b = b.rid
    WHERE a.vec_id % {EVERY} = 0
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST) AS place
    FROM pairs WHERE same QUALIFY place <= {POSITIVES}
)
SELECT p.anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.place ORDER BY n.score DESC, n.other_id NULLS LAST)::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives AS p JOIN pairs AS n
  ON n.a = p.a AND NOT n.same AND {LOW_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH_PERCENT} * p.score
QUALIFY rank <= {NEGATIVES}
"""
