"""Pay and vacancy evidence of postings: structured, then parsed, then derived by others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger.functions import text


def chosen(postings: DataFrame, derived: DataFrame, models: DataFrame) -> DataFrame:
    """posting_id, kind, value, model, version: of the derived statements of each posting and kind the one to use.

    derived: posting_id, kind, value, model, version, derived_at; models:
    model, preference (smaller first). A statement counts only if the text of
    the posting literally contains it and its model is listed. The preferred
    model goes first, then its newest version, then the latest statement.
    """
    said = derived.where("value <> ''").join(models.select("model", "preference"), "model")  # models are a catalog; AQE broadcasts it
    literal = said.join(postings.select("posting_id", "text"), "posting_id").where(F.contains("text", "value"))
    order = F.struct("preference", (-F.col("version")).alias("v"), (-F.unix_micros("derived_at")).alias("at"), "value", "model")
    best = literal.groupBy("posting_id", "kind").agg(F.min(order).alias("b"))
    return best.select("posting_id", "kind", "b.value", "b.model", (-F.col("b.v")).alias("version"))


def vacancies(postings: DataFrame, derived: DataFrame) -> DataFrame:
    """posting_id, vacancy_statement, derived, model.

    The posting's own statement comes first. A derived one (posting_id,
    value, model; one a posting) counts only if the text literally contains it.
    """
    p = postings.select("posting_id", "text", text.vacancy_statement(F.col("text")).alias("own"))
    j = p.join(derived.select("posting_id", "value", "model"), "posting_id", "left")
    takes = F.col("own").isNull() & (F.col("value") != "") & F.contains("text", "value")
    takes = F.coalesce(takes, F.lit(False))
    return j.select("posting_id", F.coalesce("own", F.when(takes, F.col("value"))).alias("vacancy_statement"), takes.alias("derived"), F.when(takes, F.col("model")).alias("model"))


def salaries(stated: DataFrame, parsed: DataFrame, derived: DataFrame) -> DataFrame:
    """Best pay of each posting over tables of posting_id, low, high, period: stated, else parsed, else derived; origin says which."""
    ranked = (
        stated.where("low IS NOT NULL OR high IS NOT NULL").withColumn("rank", F.lit(0))
        .unionByName(parsed.withColumn("rank", F.lit(1)))
        .unionByName(derived.withColumn("rank", F.lit(2)))
    )
    best = ranked.groupBy("posting_id").agg(F.min(F.struct("rank", "low", "high", "period")).alias("b"))
    origin = F.element_at(F.array(F.lit("STATED"), F.lit("PARSED"), F.lit("DERIVED")), F.col("b.rank") + 1)
    return best.select("posting_id", "b.low", "b.high", "b.period", origin.alias("origin"))
