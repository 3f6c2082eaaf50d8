"""Plans for keeping an index in step with its originals: what to reuse, skip, re-index, repair, delete. Plans are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reusable_vectors(fresh: DataFrame, stored: DataFrame, dimension: int) -> DataFrame:
    """fresh (point_id, fingerprint) with the stored vector of the same point, fingerprint and dimension; null: embed it."""
    fit = stored.filter(F.size("vector") == dimension).select("point_id", "fingerprint", "vector")
    return fresh.join(fit, ["point_id", "fingerprint"], "left")


def unchanged(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Incoming documents (name, sha) that need no parsing: same content, complete, not stale."""
    same = catalogue.filter(~F.col("incomplete") & ~F.col("stale")).select("name", "sha")
    return incoming.join(same, ["name", "sha"], "left_semi")


def stale_points(before: DataFrame, after: DataFrame) -> DataFrame:
    """(filename, point_id) of the points that a document's new version no longer has; deleted after the write."""
    own = after.select("filename").distinct()
    return before.join(own, "filename", "left_semi").join(after, ["filename", "point_id"], "left_anti").select("filename", "point_id")


def reindex_plan(catalogue: DataFrame, originals: DataFrame, busy: DataFrame) -> DataFrame:
    """(name, outcome) of stale or incomplete documents: queued, busy or no_original."""
    todo = catalogue.filter(F.col("stale") | F.col("incomplete")).select("name")
    there = originals.select("name", F.lit(True).alias("has"))
    running = busy.select("name", F.lit(True).alias("runs"))
    out = todo.join(there, "name", "left").join(running, "name", "left")
    return out.select("name", F.when(F.col("runs"), "busy").when(F.col("has"), "queued").otherwise("no_original").alias("outcome"))


def repair_plan(stored: DataFrame, indexed: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """(id, action): originals without passages are deleted, unless so many are missing that the index itself seems lost."""
    orphans = stored.join(indexed, "id", "left_anti")
    counts = orphans.agg(F.count(F.lit(1)).alias("lost")).crossJoin(stored.agg(F.count(F.lit(1)).alias("all")))  # one row
    guard = (F.col("lost") >= least) & (F.col("lost") > share * F.col("all"))
    return orphans.crossJoin(F.broadcast(counts)).select("id", F.when(guard, "index_lost").otherwise("delete_original").alias("action"))


def removed_files(indexed: DataFrame, scanned: DataFrame, scan_complete: Column) -> DataFrame:
    """Names whose file is gone; none if the scan broke off or found nothing."""
    seen = scanned.agg((F.count(F.lit(1)) > 0).alias("some"))
    return indexed.join(scanned, "name", "left_anti").crossJoin(F.broadcast(seen)).filter(F.col("some") & scan_complete).select("name")  # one row


def patched(attributes: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Document attributes with changes put over them, column by column where a change has a value."""
    cols = [c for c in attributes.columns if c != key]
    both = attributes.alias("a").join(changes.alias("c"), key, "full")
    return both.select(key, *[F.coalesce(F.col(f"c.{c}"), F.col(f"a.{c}")).alias(c) if c in changes.columns else F.col(f"a.{c}") for c in cols])


def patched_catalogue(before: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "filename") -> DataFrame:
    """A stored catalogue with only the changed names' rows taken from a fresh aggregate over those names."""
    return before.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def findings(settings: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(rule, level) that a settings row breaks; rules: name, level, the condition that is wrong."""
    hits = F.array(*[F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, level, bad in rules])
    return settings.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.*")


def fingerprint_column(decided_by: dict[str, Column]) -> Column:
    """settings.fingerprint of settings that stand in columns: whole numbers as they are, texts in quotes (without any inside)."""

    def shown(c: Column) -> Column:
        text = c.cast("string")
        return F.when(F.typeof(c) == "string", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)

    items = [F.concat(F.lit(f'"{k}": '), shown(decided_by[k])) for k in sorted(decided_by)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")), 256), 1, 12)


def fingerprint_state(passages: DataFrame, current: str) -> DataFrame:
    """(filename, passages, old, fingerprints, stale): passages made under other settings than current, or under none that was told."""
    old = ~F.col("fingerprint").eqNullSafe(current)
    return passages.groupBy("filename").agg(F.count("*").alias("passages"), F.count_if(old).alias("old"), F.count_distinct("fingerprint").alias("fingerprints")).withColumn("stale", F.col("old") > 0)


#: What an index was built with; another value of any makes its vectors unlike new ones.
BUILT_WITH = ("model", "dimension", "language", "prefix")


def index_compatibility(indexes: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """(index_id, verdict, differs) of indexes (index_id, points, and the columns of BUILT_WITH) against what is wanted.

    fits; refused with the names that differ where it holds points; rebuilt where it holds none. An index that tells nothing
    of a name (null) is from before that was written down: it differs, except in language and prefix, which had one value then.
    """
    tells = lambda c: F.col(c).isNotNull() if c in ("language", "prefix") else F.lit(True)
    differs = F.array_compact(F.array(*[F.when(tells(c) & ~F.col(c).eqNullSafe(F.lit(wanted[c])), F.lit(c)) for c in BUILT_WITH]))
    rows = indexes.select("index_id", "points", differs.alias("d"))
    verdict = F.when(F.size("d") == 0, "fits").when(F.coalesce("points", F.lit(0)) > 0, "refused").otherwise("rebuilt")
    return rows.select("index_id", verdict.alias("verdict"), F.array_join("d", ",").alias("differs"))
