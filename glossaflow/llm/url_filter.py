"""URL filter: rules looked up in sorted digest arrays.

A rule is a host and the beginning of a path, and fits the host, its subdomains, and
paths that start with the rule's. Every string a fitting rule could have (host
suffix and path beginning, of the lengths rules have) is a probe. Probes are made
distinct, and probes and rules meet by their 64-bit xxhash: a task writes the digests
of its rules, sorted, to a temporary file, maps it into memory, looks up whole
batches of probes by binary search, and compares the stored strings, since digests
may collide. Rules of any number are spread over the tasks, and no task holds more
than a batch in memory.

Defined results: null urls and urls without ``://`` have an empty host and path and
fit no rule; of fitting rules the longest wins, of equally long ones the longer
host, then ``block``; no fitting rule means ``allow``, since the list is of what to
block; rules that occur twice count once.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules ``(host, path, verdict)`` of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _labels(host: Column) -> Column:
    """Number of a host's labels."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _probes(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """``host, path, key`` of every rule string that would fit a url.

    Suffixes have as many labels as rules have, so a host of very many labels has few.
    """
    suffixes = F.array_compact(F.array(*[
        F.when(_labels(F.col("host")) >= k, F.substring_index("host", ".", -k)) for k in labels
    ])).cast("array<string>")
    beginnings = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    return (
        urls.withColumn("_suffix", F.explode(suffixes)).withColumn("_n", F.explode(beginnings))
        .filter(F.length("path") >= F.col("_n"))
        .select("host", "path", F.concat("_suffix", F.substr("path", F.lit(1), F.col("_n"))).alias("key"))
    )


class DigestArray:
    """Sorted digests and their strings, in files mapped into memory."""

    def __init__(self, folder: str):
        self._at = {name: os.path.join(folder, name) for name in ("digests", "offsets", "strings", "verdicts")}
        self._files = {name: open(path, "wb") for name, path in self._at.items()}
        self._end = 0
        self._files["offsets"].write(np.zeros(1, np.int64).tobytes())

    def append(self, batch: pa.RecordBatch) -> None:
        """More rules, in ascending order of their digests."""
        keys = [k.encode() for k in batch.column("key").to_pylist()]
        ends = self._end + np.cumsum([len(k) for k in keys])
        self._end = int(ends[-1])
        blocks = np.array([v == "block" for v in batch.column("verdict").to_pylist()], np.uint8)
        for name, data in (
            ("digests", batch.column("digest").to_numpy().tobytes()), ("offsets", ends.astype(np.int64).tobytes()),
            ("strings", b"".join(keys)), ("verdicts", blocks.tobytes()),
        ):
            self._files[name].write(data)

    def seal(self) -> DigestArray:
        for f in self._files.values():
            f.close()

        def mapped(name: str, kind) -> np.ndarray:
            path = self._at[name]
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

        self.digests, self.offsets = mapped("digests", np.int64), mapped("offsets", np.int64)
        self.strings, self.blocks = mapped("strings", np.uint8), mapped("verdicts", np.uint8)
        return self

    def find(self, digests: np.ndarray, keys: pa.Array) -> tuple[list[int], list[bool]]:
        """Rows that are rules, and whether those block."""
        lo, hi = np.searchsorted(self.digests, digests), np.searchsorted(self.digests, digests, "right")
        rows, block = [], []
        for i in np.flatnonzero(hi > lo).tolist():
            want = keys[i].as_py().encode()
            for k in range(int(lo[i]), int(hi[i])):
                if self.strings[self.offsets[k]:self.offsets[k + 1]].tobytes() == want:
                    rows.append(i)
                    block.append(bool(self.blocks[k]))
                    break
        return rows, block


def _lookup(rules: DataFrame, probes: DataFrame) -> DataFrame:
    """``key, verdict`` of the probes that are rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            array, sealed = DigestArray(folder), False
            for batch in batches:
                probe = batch.column("probe").to_numpy(zero_copy_only=False)
                some = int((~probe).sum())
                if some:
                    array.append(batch.slice(0, some))
                rest = batch.slice(some)
                if rest.num_rows:
                    if not sealed:
                        array, sealed = array.seal(), True
                    rows, block = array.find(rest.column("digest").to_numpy(), rest.column("key"))
                    yield pa.RecordBatch.from_arrays(
                        [rest.column("key").take(pa.array(rows, pa.int64())), pa.array(["block" if b else "allow" for b in block], pa.string())],
                        ["key", "verdict"],
                    )

    digest = F.xxhash64("key")
    both = rules.select(digest.alias("digest"), "key", "verdict", F.lit(False).alias("probe")).union(
        probes.select(digest.alias("digest"), "key", F.lit("").alias("verdict"), F.lit(True).alias("probe"))
    )
    ordered = both.repartition("digest").sortWithinPartitions("probe", "digest", "key")
    return ordered.mapInArrow(run, "key string, verdict string")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    listed = rules.select(F.concat(host, path).alias("key"), _labels(host).alias("_l"), F.length(path).alias("_p"), "verdict")
    # One number per length of path and per count of labels that rules have, not per rule.
    labels, lengths = (sorted(r[0] for r in listed.select(c).distinct().collect()) for c in ("_l", "_p"))
    listed = listed.groupBy("key").agg(F.max("verdict").alias("verdict"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    probes = _probes(urls.select("host", "path").distinct(), labels, lengths)
    found = _lookup(listed, probes.select("key").distinct())
    host_length = F.instr("key", "/")
    rank = F.struct(F.length("key").alias("n"), host_length.alias("h"), F.col("verdict").alias("verdict"), F.col("key").alias("rule"))
    best = probes.join(found, "key").groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
