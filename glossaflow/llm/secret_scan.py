"""Secret scan with multipart credential linking, in SQL functions only.

Secrets that show by themselves (the base kinds) are reported as they are. Weak
candidates are reported only with their complements: a part of a credential is an
access identifier (an access key id, or a value assigned to a user or client id), a
secret (an assigned or hexadecimal base secret, or a mixed random-looking string),
or an endpoint (a url, or host and port). All parts of a row form one table; an
interval join finds, for each part, whether parts of the other kinds stand within
``SCOPE`` characters of it, between the nearest ends. The join is a range frame over the
row's parts, which keeps the furthest end so far and the next beginning and makes no
pairs. A weak secret counts next to an identifier; a weak identifier counts next to a
secret and an endpoint, or an endpoint next to both, or either next to a secret that has
both beside it, however long that is; weak parts that touch a base span are left out,
since it is reported.

Positions are code points, ends exclusive. Defined results: null text counts as
empty; every row is judged by itself, whatever its id; of weak candidates of several
kinds at one place each kind is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

#: Patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

# Patterns of the weak kinds.
IDENTIFIER = r"""(?i)(?:client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
SECRET = r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"""
ENDPOINT = r"""(?i)(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}:[0-9]{2,5}\b)"""


PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT)))


def _placed(kind: str) -> Column:
    """Matches ``_m`` as ``{start, end, kind, value}``; pieces ``_g`` give the places."""
    matches, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    sizes = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("size"))
    starts = F.aggregate(
        sizes, zero,
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.array_append(acc["starts"], acc["at"] + s["gap"]).alias("starts")),
        lambda acc: acc["starts"],
    )
    rows = F.transform(
        F.arrays_zip(starts.alias("start"), matches.alias("value")),
        lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"), x["value"].alias("value"),
        ),
    )
    return F.when(F.size(matches) > 0, rows).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>"))


def _with_parts(documents: DataFrame) -> DataFrame:
    """``doc_id, _row, _parts``: each pattern is searched once per text."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    found = rows.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in PATTERNS.items()])
    gaps = found.select("*", *[
        F.when(F.size(f"_m_{k}") > 0, F.transform(F.split("_text", p, -1), lambda s: F.length(s))).alias(f"_g_{k}") for k, p in PATTERNS.items()
    ])
    long_enough = lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= LEAST_VALUE
    parts = [F.filter(_placed(k), long_enough) if k == "assign" else _placed(k) for k in KINDS]
    return gaps.select("doc_id", "_row", F.concat(*parts).alias("_parts"))


def _spans(parts: Column) -> Column:
    """``kind:start:end``, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(parts)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row."""
    part = _with_parts(documents).select("doc_id", "_row", F.explode_outer("_parts").alias("p")).select("doc_id", "_row", "p.start", "p.end", "p.kind")
    so_far = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("_row").orderBy("start").rangeBetween(0, Window.currentRow)
    kind = F.col("kind")
    base = kind < 3
    role = (
        F.when(kind.isin(1, 3), 1).when(kind.isin(0, 2, 4), 2).when(kind == 5, 3)
    )
    ahead = Window.partitionBy("_row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)

    def near(wanted: Column) -> Column:
        """Whether a wanted part ends, or begins, within the scope of this one's nearer edge."""
        left = F.max(F.when(wanted, F.col("end"))).over(so_far) >= F.col("start") - scope
        right = F.min(F.when(wanted, F.col("start"))).over(ahead) <= F.col("end") + scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    marked = part.withColumns({
        "_ids": near(role == 1), "_secrets": near(role == 2), "_ends": near(role == 3),
        # The base span that reaches furthest of those that begin before, and the next.
        "_reach": F.max(F.when(base, F.col("end"))).over(before), "_here": F.max(F.when(base, F.col("end"))).over(same),
        "_next": F.min(F.when(base, F.col("start"))).over(ahead),
    })
    touches = (F.coalesce("_reach", F.lit(-1)) > F.col("start")) | F.col("_here").isNotNull() | (F.coalesce("_next", F.lit(1 << 30)) < F.col("end"))
    marked = marked.withColumn("_whole", near((role == 2) & F.col("_ids") & F.col("_ends")))
    linked = (
        ((kind == 4) & F.col("_ids"))
        | ((kind == 3) & ((F.col("_secrets") & F.col("_ends")) | F.col("_whole")))
        | ((kind == 5) & ((F.col("_secrets") & F.col("_ids")) | F.col("_whole")))
    )
    kept = marked.withColumn("_keep", base | (linked & ~touches))
    span = F.when(F.col("_keep"), F.struct("start", "end", "kind"))
    grouped = kept.groupBy("_row", "doc_id").agg(
        *[F.count_if(kind == k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.collect_list(span).alias("_all")
    )
    ordered = F.transform("_all", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return grouped.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_spans(F.filter(ordered, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _spans(ordered).alias("spans"),
    )
