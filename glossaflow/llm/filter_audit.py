"""How quality filters interact: what every order of them removes, step by step.

Each filter leaves a table of the rows that fail it (an id table). All that an order
does follows from the set of filters before a step, so the audit works on the 32 sets,
not on the 120 orders:

- survivors of a set: rows, by row id, left after left-anti joins with the id tables
  of the set; rows in no id table survive every set and are counted once;
- removed by a filter after a set: its id table, left-semi joined with the survivors;
- redundant: its id table, left-anti joined with the survivors;
- what fails one filter only is what that filter removes after all others.

Joins of rows are on a row id, or on row id and set, and do not grow with a part. First
holders of texts and marks of documents are stored before rows meet them, so that Spark
can split a text or a document id that many rows have. Nothing is broadcast: Spark
judges by bytes on disk, and the driver would hold many times as many. Orders meet the
counts at last, for each part, as rows of the result.

Defined results: null text counts as empty; a null source is the part named by the
empty string; every row is a document of its own, also where an id repeats; a null id
is neither a smaller id nor has one; a document is good (toxic) where any label row of
its id says so; an empty table has no parts and no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.tables import drop, keep

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
SPACES = "\t\n\x0b\x0c\r"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> Column:
    """Names of the filters A to D that a text fails."""
    blank = F.translate(text, SPACES, " " * len(SPACES))
    words = F.filter(F.split(blank, " "), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit(SYMBOLS)),
    }
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in fails.items()]))


def _facts(documents: DataFrame) -> DataFrame:
    """One small row per document: row id, part, digest of the text, filters A to D failed."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(text).alias("failed"),
    )


def copied(facts: DataFrame) -> DataFrame:
    """``digest, first``: texts of several ids, and the smallest. Groups combine before the shuffle."""
    ids = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"))
    return ids.filter(F.col("first") < F.col("_last")).select("digest", "first")


def marked(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic`` of the documents that are either."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    return marks.filter("doc_id IS NOT NULL AND (good OR toxic)")


def failing(facts: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``filter, rid, part, good, toxic``: a row for every filter that a document fails."""
    own = facts.select("rid", "doc_id", "part", F.explode("failed").alias("filter"))
    copies = facts.join(texts.hint("merge"), "digest").filter(F.col("doc_id") > F.col("first"))
    copies = copies.select("rid", "doc_id", "part", F.lit("E").alias("filter"))
    known = own.unionByName(copies).join(marks.hint("merge"), "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return known.select("filter", "rid", "part", flag("good"), flag("toxic"))


def survivors(facts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``rid, part, set`` of failing rows that no filter of ``set`` (a bit mask) removes.

    Filter by filter, a row goes on without it, and also with it unless its id table
    holds the row; so a row that fails many filters leaves few rows.
    """
    ids = tables["A"].select("rid")
    for name in FILTERS[1:]:
        ids = ids.unionAll(tables[name].select("rid"))
    rows = facts.select("rid", "part").join(ids.hint("merge"), "rid", "left_semi").withColumn("set", F.lit(0))
    for name in FILTERS:
        both = F.explode(F.array(F.col("set"), F.col("set") + _bit(name)))
        rows = rows.select("rid", "part", both.alias("set"))
        fails = tables[name].select(F.col("rid").alias("_rid"))
        chosen = F.col("set").bitwiseAND(F.lit(_bit(name))) != 0
        rows = rows.join(fails.hint("merge"), (F.col("rid") == F.col("_rid")) & chosen, "left_anti")
    return rows


def _orders() -> Column:
    """All orders of the filters, as an array of arrays."""
    names = F.array(*[F.lit(c) for c in FILTERS])
    orders = F.array(F.array().cast("array<string>"))
    for _ in FILTERS:
        longer = F.transform(orders, lambda o: F.transform(
            F.array_except(names, o), lambda f: F.concat(o, F.array(f))
        ))
        orders = F.flatten(longer)
    return orders


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order of the five filters and step."""
    spark = documents.sparkSession
    facts, facts_path = keep(_facts(documents), "facts")
    texts, texts_path = keep(copied(facts), "copied")
    marks, marks_path = keep(marked(labels), "marked")
    every, ids_path = keep(failing(facts, texts, marks), "failing", "filter")
    drop(spark, texts_path, marks_path)
    tables = {name: every.filter(F.col("filter") == name) for name in FILTERS}
    alive, alive_path = keep(survivors(facts, tables), "survivors")

    bit = F.lit(0)
    for name in FILTERS:
        bit = F.when(F.col("filter") == name, _bit(name)).otherwise(bit)
    other_sets = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda s: s.bitwiseAND(F.col("_bit")) == 0)
    asked = every.withColumn("_bit", bit).select("*", F.explode(other_sets).alias("set"))
    here = asked.join(alive.hint("merge"), ["rid", "set"], "left_semi").groupBy("part", "filter", "set").agg(
        F.count("*").alias("removed"),
        F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"),
    )
    earlier = asked.join(alive.hint("merge"), ["rid", "set"], "left_anti").groupBy("part", "filter", "set").agg(
        F.count("*").alias("redundant")
    )
    clean = facts.join(every.select("rid").hint("merge"), "rid", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    left = alive.groupBy("part", "set").agg(F.count("*").alias("left"))
    left = left.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", "left"))).alias("left"))
    # From here on a few rows per part.
    counts, counts_path = keep(
        here.join(earlier, ["part", "filter", "set"], "full"), "counts"
    )
    whole = facts.select("part").distinct()
    for numbers in (clean, left):
        whole = whole.join(numbers.hint("merge"), "part", "left")
    whole, whole_path = keep(whole, "parts")
    drop(spark, facts_path, ids_path, alive_path)

    steps = whole.select("part", "clean", "left", F.explode(_orders()).alias("_order"))
    steps = steps.select("*", F.posexplode("_order").alias("_at", "filter")).withColumn("_bit", bit)
    before = F.aggregate(
        F.slice("_order", F.lit(1), F.col("_at")), F.lit(0),
        lambda s, f: s + F.element_at(F.array(*[F.lit(_bit(c)) for c in FILTERS]), F.instr(F.lit(FILTERS), f)),
    )
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    steps = steps.withColumn("set", before).select(
        "part", F.array_join("_order", "").alias("filter_order"), (F.col("_at") + 1).cast("int").alias("step"), "filter", "set",
        (number(F.col("clean")) + number(F.element_at("left", F.col("set") + F.col("_bit")))).alias("kept"),
    )
    alone = counts.filter(F.col("set") == (1 << len(FILTERS)) - 1 - bit).select(
        "part", "filter", F.col("removed").alias("unique_fails")
    )
    orders_with = lambda s: F.element_at(
        F.array(*[F.lit(k) for k in (24, 6, 4, 6, 24)]), F.bit_count(s).cast("int") + 1
    )
    shares = counts.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders_with(F.col("set"))).alias("shapley")
    )
    steps = steps.join(counts.hint("merge"), ["part", "filter", "set"], "left")
    for numbers in (alone, shares):
        steps = steps.join(numbers.hint("merge"), ["part", "filter"], "left")
    return steps.select(
        "part", "filter_order", "step", "kept",
        *[number(F.col(c)).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
    )


ORACLE_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), facts AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len(words) < {LEAST_WORDS},
        100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words),
        100 * len(regexp_extract_all(text, '[A-Z]')) > {MOST_CAPITALS} * length(text),
        regexp_matches(text, '{SYMBOLS}'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
    ] AS fails
    FROM texts LEFT JOIN marks USING (doc_id)
), kinds AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM facts GROUP BY ALL
), names AS (
    SELECT unnest(range(1, 6)) AS f
), orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS o
    FROM names a, names b, names c, names d, names e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT o, unnest(range(1, 6)) AS step FROM orders
), counted AS (
    SELECT part, o, step,
        coalesce(sum(n) FILTER (len(list_filter(o[1:step], lambda x: fails[x])) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(o[1:step - 1], lambda x: fails[x])) = 0), 0) AS removed,
        coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
        coalesce(sum(n) FILTER (good AND fails[o[step]] AND len(list_filter(o[1:step - 1], lambda x: fails[x])) = 0), 0) AS good_lost,
        coalesce(sum(n) FILTER (toxic AND fails[o[step]] AND len(list_filter(o[1:step - 1], lambda x: fails[x])) = 0), 0) AS toxic_lost
    FROM kinds, steps GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: '{FILTERS}'[x]), '') AS filter_order, step::INTEGER AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, o[step])::BIGINT AS shapley
FROM counted
"""
