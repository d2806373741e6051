"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a weight schedule: its weights at equally spaced knots over training time 0..1,
linear in between. The integral of a schedule is the source's weight; weights share out the demand
for tokens, up to a cap per source. A source's documents stand in a pseudo-random but fixed order,
repeated as often as the demand needs. The cumulative demand of the source, which is the integral of
its schedule, is inverted at the token where a copy of a document starts: that is the copy's position
in training, and documents are range-sorted by it.

Running sums inside a source never meet in one task: rows are bucketed by the leading digits of their
order key, buckets are summed first, and only rows of one bucket are put in order together.

Defined results: a null or empty text has size 0, is never taken and has no position; null is a source
of its own; repeated rows are rows of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bytestrata.llm.common import carried, cut, pick

WORD = r"[^\x20\x09-\x0D]+"
#: Schedules of the sources in code-point order, null last, repeating: they integrate to 3, 1 and 2.
SCHEDULES = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))
#: Tokens wanted, as a share of all tokens, and the most times that a source is repeated.
SHARE, CAP = 1.5, 2
#: Rows that stand in one bucket of the order, about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(knots: Sequence[float]) -> list[float]:
    """The running integral of a schedule at its knots."""
    h, out = 1 / (len(knots) - 1), [0.0]
    for a, b in zip(knots, knots[1:]):
        out.append(out[-1] + h * (a + b) / 2)
    return out


def targets(sizes: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) of each source to its class, weight and target.

    Targets are proportional to weights, none above cap times its source; what is above is shared
    again by weight. So target = min(cap * size, level * weight), and the level is found by taking the
    sources in the order in which they reach their caps. One row per source: the windows below see
    sources, not documents.
    """
    n = len(schedules)
    weights = F.array(*(F.lit(integral(s)[-1]) for s in schedules))
    named = sizes.withColumn("class", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % n).cast("int"))
    named = named.withColumn("weight", F.element_at(weights, F.col("class") + 1)).withColumn("most", F.col("source_size") * cap)
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = named.withColumn("own_level", level)
    fits = F.when(F.col("most") >= F.col("own_level") * F.col("weight"), F.col("own_level"))
    # the first source that stays below its cap sets the level; if none does, all stand at their caps
    found = found.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    return found.select("source", "source_size", "class", "weight", target.alias("target"))


def invert(schedules: Sequence[Sequence[float]], cls: Column, share: Column) -> Column:
    """The time at which a source of the class has had that share (0..1) of its demand."""
    knots = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in schedules)), cls + 1)
    areas = F.element_at(F.array(*(F.array(*map(F.lit, integral(s))) for s in schedules)), cls + 1)
    steps = F.size(knots) - 1
    wanted = share * F.element_at(areas, -1)
    at = F.least(F.greatest(F.size(F.filter(areas, lambda x: x <= wanted)), F.lit(1)), steps)
    rest = F.greatest(wanted - F.element_at(areas, at), F.lit(0.0))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    # a * u + (b - a) * steps / 2 * u * u = rest, in the form that is stable for any sign of b - a
    u = 2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * steps * rest, F.lit(0.0))))
    return F.when(rest <= 0, (at - 1) / steps).otherwise((at - 1) / steps + u)


def mix(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and copies.

    copies: array of (epoch, taken, position), one element for each time that the mix takes the document;
    taken counts words. The last copy that a source's demand reaches is taken in part, so that the words
    taken from a source add up to its target, rounded.
    """
    size = word_count(F.col("text"))
    # the text is in the key, so that rows without a doc_id of their own still spread over the buckets
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    sized = cut(pick(docs, "doc_id", "source", "text").select("doc_id", "source", size.alias("size"), key.alias("key")))
    digits, rows = 1, sized.count()
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    by = ["source", "bucket"]
    buckets = sized.groupBy(*by).agg(F.sum("size").alias("bucket_size"))
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    goals = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedules, share, cap)
    same = lambda a, b, on: a.join(b.withColumnsRenamed({c: f"_{c}" for c in on}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left").drop(*(f"_{c}" for c in on))
    starts = cut(same(buckets, goals, ["source"]).drop("bucket_size"))
    inside = W.partitionBy(*by).orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = same(placed, starts, by).withColumn("before", F.col("bucket_before") + F.col("within"))
    demand = F.round("target").cast("long")

    def copy(epoch: Column) -> Column:
        start = F.col("before") + epoch * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), demand - start))
        return F.struct(epoch.cast("int").alias("epoch"), taken.cast("long").alias("taken"), invert(schedules, F.col("class"), start / F.col("target")).alias("position"))

    copies = F.filter(F.array(*(copy(F.lit(k)) for k in range(cap))), lambda c: c["taken"] > 0)
    none = F.array().cast("array<struct<epoch:int,taken:bigint,position:double>>")
    return placed.select("doc_id", "source", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(none).alias("copies"))


def training_order(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The documents, one row for each time that the mix takes at least half of one, range-sorted by position in training.

    Whole texts meet their decisions by doc_id, source and size, and move once more to their positions.
    """
    docs, back = carried(docs, "doc_id", "source", "text")
    mixed = mix(docs, schedules, share, cap)
    kept = mixed.withColumn("copies", F.filter("copies", lambda c: 2 * c["taken"] >= F.col("size"))).filter(F.size("copies") > 0)
    # rows alike in all three are interchangeable here, as long as each of them is taken about as often
    by = ["doc_id", "source", "size"]
    place = lambda *order: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    kept = kept.withColumn("place", place(F.element_at("copies", 1)["position"])).select(*(F.col(c).alias(f"_{c}") for c in (*by, "place")), "copies")
    own = docs.withColumn("size", word_count(F.col("text"))).withColumn("place", place("text"))
    joined = own.join(kept, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "place")])
    return back(joined.withColumn("_copy", F.explode("copies")).orderBy("_copy.position", "doc_id", "_copy.epoch"))


def mixture(docs: DataFrame) -> DataFrame:
    """Per document the words that the mix takes, range-sorted by the position of its first copy; documents that are not taken come last."""
    mixed = mix(docs)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    first = F.round(F.element_at(F.transform("copies", lambda c: c["position"]), 1), 6)
    out = mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", taken.alias("taken"), F.when(F.size("copies") > 0, first).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS content FROM documents
), keyed AS (
  SELECT doc_id, source, size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR) || ':' || content) AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), named AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class, source_size * 2 AS most FROM sources
), weighed AS (
  SELECT *, CASE class WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM named
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own_level,
    row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place
  FROM weighed WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, class, least(most::DOUBLE, coalesce((SELECT arg_min(own_level, place) FROM levels WHERE most >= own_level * weight) * weight, most::DOUBLE)) AS target FROM levels
), placed AS (
  SELECT doc_id, k.source, size, source_size, class, target, CAST(round(target) AS BIGINT) AS demand,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
), shares AS (
  SELECT *, CASE class WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE class WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS b,
    start / target * CASE class WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS rest FROM placed
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, demand - start)) + greatest(0, least(size, demand - start - source_size)) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND demand > start THEN round(CASE WHEN rest <= 0 THEN 0 ELSE 2 * rest / (a + sqrt(greatest(a * a + 2 * (b - a) * rest, 0))) END, 6) END AS position
FROM shares
"""
