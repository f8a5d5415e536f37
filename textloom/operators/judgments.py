"""Judgments of answers over time: which still hold for what is to be judged now, which attempts are sound, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.merkle import row_digest


def contexts(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(query_id, context): a digest of all that a judgment of the query rests on."""
    return rows.select(F.col(id_col).alias("query_id"), row_digest([id_col, *columns]).alias("context"))


def attempt_faults(attempts: Column, status: Column, most: int) -> Column:
    """What is wrong with a saved list of attempts (attempt, status): their number, a sequence that isn't 1, 2, 3, an unknown
    status, a success before the last, a last one that the row's status contradicts, a failure before all were made."""
    n = F.coalesce(F.size(attempts), F.lit(0))
    each = lambda test: F.coalesce(F.exists(attempts, test), F.lit(False))
    last = F.try_element_at(attempts, F.lit(-1))["status"]
    checks = {
        "count": (n < 1) | (n > most),
        "sequence": F.coalesce(F.transform(attempts, lambda a: a["attempt"]) != F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(True)) & (n > 0),
        "status": each(lambda a: ~F.coalesce(a["status"].isin("success", "failed"), F.lit(False))),
        "early_success": F.coalesce(F.exists(F.slice(attempts, 1, F.greatest(n - 1, F.lit(0))), lambda a: F.coalesce(a["status"] == "success", F.lit(False))), F.lit(False)),
        "last": (n > 0) & ~F.coalesce(last == status, F.lit(False)),
        "gave_up": F.coalesce(status == "failed", F.lit(False)) & (n > 0) & (n < most),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


def compared(saved: DataFrame, now: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, state, faults) of every query of either side. saved: query_id, context, status, attempts. now: query_id,
    context. state: gone (not asked any more), new, changed (its context is another), unsound (attempts at fault), repeated
    (saved more than once), or holds. Only what is new, changed, unsound or repeated has to be judged again."""
    # one row a query, however often it was saved
    once = saved.groupBy("query_id").agg(F.count(F.lit(1)).alias("times"), *[F.any_value(c).alias(c) for c in ("context", "status", "attempts")])
    both = once.join(now.select("query_id", F.col("context").alias("now")), "query_id", "full_outer")
    faults = F.when(F.col("times").isNotNull(), attempt_faults(F.col("attempts"), F.col("status"), most)).otherwise(F.array().cast("array<string>"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("times").isNull(), "new").when(F.col("times") > 1, "repeated").when(~F.col("context").eqNullSafe(F.col("now")), "changed").when(F.size("faults") > 0, "unsound").otherwise("holds")
    return both.withColumn("faults", faults).select("query_id", state.alias("state"), "faults")


def to_do(saved: DataFrame, now: DataFrame, most: int = 3) -> DataFrame:
    """(query_id) that have to be judged: all but those whose saved judgment holds."""
    return compared(saved, now, most).filter(~F.col("state").isin("holds", "gone")).select("query_id")


def aligned(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """Each answer with the judgment as of it: of its query and system, the latest one that is not before it. answers:
    query_id, system, at. judged: query_id, system, at, decision. A judgment before any answer of its query and system, or an
    answer without one, has the other side's columns null: unmatched shows them."""
    keys = ["query_id", "system"]
    rows = answers.select(*keys, "at", F.lit(0).alias("kind"), F.lit(None).cast(judged.schema["decision"].dataType).alias("decision")).unionByName(judged.select(*keys, "at", F.lit(1).alias("kind"), "decision"))
    w = Window.partitionBy(*keys).orderBy("at", "kind")
    marked = rows.withColumn("answered", F.max(F.when(F.col("kind") == 0, F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = marked.filter("kind = 1").groupBy(*keys, "answered").agg(F.max_by("decision", "at").alias("decision"), F.max("at").alias("judged_at"))
    asked = answers.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_answered")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "answered")]
    return asked.join(best, same, "full_outer").select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], F.col("_answered").alias("answered"), "judged_at", "decision")


def unmatched(pairs: DataFrame) -> DataFrame:
    """Rows of aligned that lack a side; a strict caller raises if there are any."""
    return pairs.filter(F.col("answered").isNull() | F.col("judged_at").isNull()).withColumn("lacks", F.when(F.col("answered").isNull(), "answer").otherwise("judgment"))


def oracle_value(kind: Column, rows: Column, snapshot: Column) -> tuple[Column, Column]:
    """(value, fault) of a replayed statement as its kind of oracle reads it. kind: scalar, row_count, database_state,
    schema_state, or any for rows. rows: JSON, a list of lists; snapshot: JSON. A scalar needs one row of one column."""
    outer = F.from_json(rows, "array<string>")
    inner = F.from_json(F.try_element_at(outer, F.lit(1)), "array<string>")
    single = F.coalesce((F.size(outer) == 1) & (F.size(inner) == 1), F.lit(False))
    value = F.when(kind.isin("database_state", "schema_state"), snapshot).when(kind == "row_count", F.coalesce(F.size(outer), F.lit(0)).cast("string")).when(kind == "scalar", F.when(single, F.try_element_at(inner, F.lit(1)))).otherwise(rows)
    return value, F.when((kind == "scalar") & ~single, F.lit("one row and one column are needed"))
