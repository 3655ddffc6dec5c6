"""Bulk items: reports, costs, progress, and the document examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(deliveries: DataFrame) -> DataFrame:
    """``deliveries(run_id, seq, ...)``: the first delivery of each run."""
    rest = [c for c in deliveries.columns if c not in ("run_id", "seq")]
    return deliveries.groupBy("run_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("run_id", "r.*")


def report(items: DataFrame) -> DataFrame:
    """Tallies of terminal states; one that is not known counts as cancelled."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    s = F.col("status")
    return items.agg(F.count("*").alias("completed"), n(s == "succeeded", "succeeded"), n(s == "failed", "failed"), n(~s.isin("succeeded", "failed"), "cancelled"))


def cost_rollup(items: DataFrame) -> DataFrame:
    """``items(status, cost map)``: sums by metric over items that succeeded, rounded."""
    return items.where("status = 'succeeded'").select(F.explode("cost").alias("metric", "amount")).groupBy("metric").agg(F.round(F.sum("amount"), 3).alias("amount"))


def progress(report: DataFrame, total: int, elapsed_s: float) -> DataFrame:
    """Rate and time left; without a rate the time left is NULL, and nothing is done while nothing is expected."""
    rate = F.col("completed") / F.lit(float(elapsed_s))
    return report.select("completed", F.lit(total).cast("bigint").alias("total"), F.round(rate, 6).alias("rate"), F.round(F.try_divide(F.lit(float(total)) - F.col("completed"), rate), 3).alias("eta_s"), ((F.lit(total) > 0) & (F.col("completed") >= total)).alias("is_done"))


def over_threshold(report: DataFrame, total: int, percents: list[float]) -> DataFrame:
    """For each threshold, whether the share of failures is strictly above it; never without items."""
    return report.select(F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("pct"), "failed").select("pct", "failed", (F.lit(total) > 0).__and__(F.col("failed") / F.lit(float(max(total, 1))) * 100.0 > F.col("pct")).alias("exceeded"))


def _strip(x):
    """Without white space at either end."""
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def extract_fields(docs: DataFrame) -> DataFrame:
    """``docs(id, text)``: (id, title, fields) of ``KEY: value`` lines.

    The first colon parts a line; both sides are trimmed, keys upper-cased, empty sides skipped. The last
    value of a key wins and TITLE is kept apart. A blank text is an error row with NULL fields.
    """
    pair = F.transform(F.split("text", "\n"), lambda s: F.struct(F.upper(_strip(F.substring_index(s, ":", 1))).alias("k"), _strip(F.substr(s, F.instr(s, ":") + 1)).alias("v"), (F.instr(s, ":") > 0).alias("c")))
    good = F.filter(pair, lambda p: p["c"] & (p["k"] != "") & (p["v"] != ""))
    d = docs.withColumn("_p", good)
    last = F.aggregate("_p", F.expr("CAST(map() AS MAP<STRING, STRING>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))
    blank = _strip("text") == ""
    d = d.withColumn("_m", last)
    return d.select("id", F.when(~blank, F.element_at("_m", "TITLE")).alias("title"), F.when(~blank, F.map_filter("_m", lambda k, _: k != "TITLE")).alias("fields"))


def classify_fields(extracted: DataFrame) -> DataFrame:
    """Class and confidence: the TYPE field, else a keyword, else unknown."""
    all_text = F.lower(F.concat_ws(" ", F.array_sort(F.map_values("fields")), "title"))
    kind = F.element_at("fields", "TYPE")
    return extracted.withColumns({
        "class": F.when(kind.isNotNull(), F.lower(kind)).when(F.contains(all_text, F.lit("amount due")), "invoice").when(F.contains(all_text, F.lit("incident")), "claim").otherwise("unknown"),
        "confidence": F.when(kind.isNotNull(), 0.95).when(F.contains(all_text, F.lit("amount due")) | F.contains(all_text, F.lit("incident")), 0.7).otherwise(0.0),
    })


def validate_fields(classified: DataFrame) -> DataFrame:
    """Warnings: the title, and the fields that the class needs."""
    need = F.when(F.col("class") == "invoice", F.array(F.lit("TOTAL"), F.lit("DATE"))).when(F.col("class") == "claim", F.array(F.lit("CLAIM_ID"))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    missing = F.concat(F.when(F.col("title").isNull(), F.array(F.lit("TITLE"))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")), F.array_except(need, F.map_keys("fields")))
    warn = F.transform(missing, lambda f: F.concat(F.lit("missing "), f, F.lit(" field")))
    return classified.withColumns({"warnings": warn, "passed": F.size(warn) == 0})
