"""Records of knowledge routing: what a question was routed to, how sure the router was, and which record counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

#: Route states as codes and as names; anything else is a failure.
STATES = {"1": "SUCCESS", "2": "LOW_CONFIDENCE", "3": "FAILED", "SUCCESS": "SUCCESS", "LOW_CONFIDENCE": "LOW_CONFIDENCE", "FAILED": "FAILED"}
HIGH, WIDENED_FROM = 0.8, 5
CANDIDATES = "array<struct<documentId:string,documentName:string,score:double>>"


def finite(c: Column) -> Column:
    """A number from text; null for blank text, other text and infinities."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def route_records(df: DataFrame) -> DataFrame:
    """The records with what is read from them: confidence as a number or null, status as a name, the candidates of
    each level and their counts (bad JSON has none), the top document, the place of the selected document among the
    candidates or null, hit and missed (the recorded test of the best three), and widened: an automatic route that was
    unsure and has at least five candidates.

    df has mode, confidence, route_status, selected_document_id, hit_selected_document and top_scopes_json,
    top_topics_json, top_documents_json; all of them may be null, and other columns are kept."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    out = df.withColumns(
        {
            "mode": text("mode"),
            "confidence": finite(F.col("confidence")),
            "route_status": F.coalesce(F.try_element_at(names, text("route_status")), F.lit("FAILED")),
            "documents": T.json_list(F.col("top_documents_json"), CANDIDATES),
            "scope_count": F.size(T.json_list(F.col("top_scopes_json"), "array<string>")),
            "topic_count": F.size(T.json_list(F.col("top_topics_json"), "array<string>")),
            "selected": T.filled(text("selected_document_id")),
        }
    )
    ids = F.transform("documents", lambda x: x["documentId"])
    first = F.get("documents", F.lit(0))
    return out.withColumns(
        {
            "document_count": F.size("documents"),
            "top_document": F.coalesce(T.filled(first["documentId"]), T.filled(first["documentName"])),
            "selected_place": F.nullif(F.array_position(ids, F.col("selected")), F.lit(0)).cast("int"),
            "hit": text("hit_selected_document") == "1",
            "missed": text("hit_selected_document") == "0",
            "widened": F.coalesce((F.col("mode") == "auto") & (F.col("confidence") < HIGH), F.lit(False)) & (F.size("documents") >= WIDENED_FROM),
        }
    )


def route_summary(records: DataFrame) -> DataFrame:
    """One row of counts, averages and rates over route_records(); the average confidence is over those
    that are numbers and has four digits, rates are in percent, null without a base."""
    mode, status, conf = F.col("mode"), F.col("route_status"), F.col("confidence")
    n = F.count(F.lit(1))
    rate = lambda part, whole: F.round(F.try_divide(F.lit(100.0) * F.count_if(part), whole), 6)
    shadow = mode == "shadow"
    return records.agg(
        n.alias("total"), F.count_if(mode == "auto").alias("auto"), F.count_if(shadow).alias("shadow"),
        *[F.count_if(status == s).alias(s.lower()) for s in ("SUCCESS", "LOW_CONFIDENCE", "FAILED")],
        F.count_if(conf >= HIGH).alias("high"), F.count_if("widened").alias("widened"), F.count_distinct("top_document").alias("top_documents"),
        F.round(F.avg(conf), 4).alias("avg_confidence"), *[F.round(F.avg(f"{c}_count"), 6).alias(f"avg_{c}s") for c in ("document", "topic", "scope")],
        rate(status == "SUCCESS", n).alias("success_rate"), rate(status != "SUCCESS", n).alias("low_rate"), rate(shadow & F.col("hit"), F.count_if(shadow & (F.col("hit") | F.col("missed")))).alias("shadow_hit_rate"),
    )


def record_of_exchange(records: DataFrame, exchange: str, arrival: str, time: str) -> DataFrame:
    """The record that counts for each exchange. Records come in by arrival: an automatic one takes the place of another
    kind whatever its time, any other takes the place of one that isn't later. A null time is the earliest; records
    without an exchange drop out. An exchange has few records, which meet in one array."""
    others = [c for c in records.columns if c not in (exchange, arrival)]
    row = F.struct(arrival, *others)
    at = lambda x: F.coalesce(F.unix_micros(x[time].cast("timestamp")), F.lit(0))
    take = lambda kept, new: F.when(kept.isNull() | ((new["mode"] == "auto") & (kept["mode"] != "auto")) | (at(new) >= at(kept)), new).otherwise(kept)
    by = records.where(F.trim(F.col(exchange).cast("string")) != "").groupBy(exchange).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a[arrival] < b[arrival], -1).when(a[arrival] > b[arrival], 1).otherwise(0)).alias("r"))
    kind = by.schema["r"].dataType.elementType.simpleString()
    return by.select(exchange, F.aggregate("r", F.lit(None).cast(kind), take).alias("k")).select(exchange, "k.*")
