"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, in DataFrame operations only.

Every document gets the key E/w: E exponential (from a hash of its id and the seed), w its quality weight. Taken in
the order of these keys, documents are a weighted sample. A source's target is spent in complete epochs first, in
which every document is taken once; what is left is a prefix of the key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import written

#: Fixed value: what counts as one word of a text's size.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights that sources take in turn, by their names in code point order; no target exceeds CAP times its source.
TURNS, CAP = (1, 2, 3), 3
#: Steps of the key's range; only the step in which a source's budget ends is sorted document by document.
STEPS = 4096
#: Characters that mark junk lines; their share lowers a document's quality weight.
MARKS = "%$#&*|!<>{}[]=_~^"


def size_of(text: str = "text") -> F.Column:
    """The number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> F.Column:
    """1 less four times the share of mark characters, at least 0.05; empty or null: 1."""
    n = F.char_length(text)
    marks = n - F.char_length(F.translate(F.col(text), MARKS, ""))
    return F.coalesce(F.greatest(1 - 4 * marks / F.when(n > 0, n), F.lit(0.05)), F.lit(1.0))


def exponential(id_col: str, seed: int) -> F.Column:
    """An exponential draw from a hash of id and seed: the first 12 hex digits of an MD5 as a uniform number."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed)))), 1, 12)
    return -F.ln((F.conv(digits, 16, 10).cast("double") + 1) / float(16**12 + 1))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target for (source, source_size): the water level over capped shares.

    One row for each source. Sources in the order of cap over weight fill up one after the other; the first level
    that leaves the rest unfilled, which is the highest of those, holds for them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*map(F.lit, TURNS)), ((rank - 1) % len(TURNS) + 1).cast("int"))
    weighed = sources.withColumn("weight", turn.cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= CAP * F.col("source_size"))
    held = open_.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(whole))
    return held.select("source", "source_size", F.least(CAP * F.col("source_size").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """id, size, source_size, target, taken for every row: how many words the mix takes of it, repeats counted.

    taken is epochs * size, plus size for the prefix of the key order that comes nearest the source's target. Null or
    empty texts have size 0 and are taken 0 words; a null source is one source of its own, last in order; rows with
    the same id and text are separate rows. Reruns agree: draws hash the id. Shuffles carry ids and sizes, no text.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), (exponential(id_col, seed) / quality_weight(text_col)).alias("key")))
    # exp(-key) lies between 0 and 1 and falls with the key
    rows = rows.withColumn("step", F.floor((1 - F.exp(-F.col("key"))) * STEPS).cast("int"))
    steps = rows.groupBy("source", "step").agg(F.sum("size").alias("step_size"))
    goal = targets(steps.groupBy("source").agg(F.sum("step_size").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("step")
    ends = steps.withColumn("before", F.sum("step_size").over(running) - F.col("step_size"))
    ends = ends.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    ends = ends.select(F.col("source").alias("s"), F.col("step").alias("t"), "before", "step_size", "source_size", "target", "epochs", "budget")
    ends = ends.withColumn("inside", (F.col("before") < F.col("budget")) & (F.col("before") + F.col("step_size") >= F.col("budget")))
    joined = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t"))).drop("s", "t")
    # only rows of the one step in which a budget ends need their own prefix sum
    sure = joined.filter(~F.col("inside")).withColumn("start", F.when(F.col("before") < F.col("budget"), F.lit(0.0)).otherwise(F.col("budget")))
    within = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter("inside").withColumn("start", (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).cast("double"))
    both = sure.unionByName(edge)
    chosen = F.when(F.col("inside"), F.col("start") + F.col("size") / 2 <= F.col("budget")).otherwise(F.col("start") < F.col("budget"))
    taken = (F.col("epochs") + chosen.cast("long")) * F.col("size")
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The rows of docs as the mix takes them: dropped where taken is 0 words of a non-empty text, repeated by epochs.

    Documents without words stay once; rows that share an id are all taken as often as the most taken of them.
    """
    times = plan(docs, id_col, text_col, source_col, seed).select(F.col(id_col).alias("_id"), F.when(F.col("size") > 0, F.col("taken") / F.greatest("size", F.lit(1))).otherwise(1).cast("int").alias("_times"))
    times = times.groupBy("_id").agg(F.max("_times").alias("_times")).filter("_times > 0")
    kept = docs.alias("d").join(times.alias("t"), F.col(f"d.{id_col}").eqNullSafe(F.col("t._id")))
    return kept.select(F.struct("d.*").alias("row"), F.explode(F.sequence(F.lit(1), F.col("t._times")))).select("row.*")


ORACLE = rf"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0)
    / coalesce(greatest(1 - 4 * ((length(text) - length(translate(text, '{MARKS}', ''))) / nullif(length(text), 0)::DOUBLE), 0.05), 1.0) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE - 3 * coalesce(sum(source_size) OVER o, 0)::DOUBLE)
    / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE level * weight <= 3 * source_size), 0) * weight) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goal),
placed AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN start + size / 2.0 <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
