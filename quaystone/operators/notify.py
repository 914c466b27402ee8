"""Rules on events and requests: webhooks, replication, CORS, form policies, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.operators.lifecycle import small


def event_matches(patterns: Column, kind: Column) -> Column:
    """No patterns, an equal one, or one that ends in :* and begins like the event."""
    hit = F.exists(patterns, lambda p: F.when(F.endswith(p, F.lit(":*")), F.startswith(kind, F.regexp_replace(p, r"\*$", ""))).otherwise(p == kind))
    return patterns.isNull() | (F.size(patterns) == 0) | hit


def webhooks(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Every event with every target that wants it. Targets are configuration; streams join the same way."""
    t = small(targets.withColumnRenamed("bucket", "target_bucket"))
    on = (events["bucket"] == t["target_bucket"]) & F.startswith(events["key"], F.coalesce(t["prefix"], F.lit(""))) & F.endswith(events["key"], F.coalesce(t["suffix"], F.lit("")))
    return events.join(t, on & event_matches(t["events"], events["kind"]))


def replications(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Every event with every replication rule of its prefix; deletes only where the rule asks for them."""
    r = small(rules.withColumnRenamed("bucket", "rule_bucket"))
    removed = F.startswith(events["kind"], F.lit("s3:ObjectRemoved"))
    on = (events["bucket"] == r["rule_bucket"]) & F.startswith(events["key"], r["prefix"]) & (~removed | r["delete_replication"])
    return events.join(r, on)


def payload(kind: Column, bucket: Column, key: Column, size: Column, etag: Column, at: Column) -> Column:
    """The JSON body of a notification."""
    return F.to_json(F.struct(kind.alias("EventName"), F.concat(bucket, F.lit("/"), key).alias("Key"), size.alias("Size"), etag.alias("ETag"), at.alias("Time")))


def origin_allowed(patterns: Column, origin: Column) -> Column:
    """A star, the origin itself, or a star followed by how the origin ends."""
    return F.exists(patterns, lambda p: (p == "*") | (p == origin) | (F.startswith(p, F.lit("*")) & F.endswith(origin, F.regexp_replace(p, r"^\*", ""))))


def cors(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Each request with the position of the first CORS rule that fits (null if none).

    A bucket's rules are one row, in their order; requests are not grouped, and not shuffled while rules are few.
    """
    each = rules.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("rule_pos", "origins", "methods"))).alias("_rules"))
    rows = requests.join(small(each), "bucket", "left")
    method = lambda r: F.exists(r["methods"], lambda m: (m == "*") | (F.lower(m) == F.lower(F.col("method"))))
    fits = F.filter("_rules", lambda r: origin_allowed(r["origins"], F.col("origin")) & method(r))
    return rows.withColumn("rule_pos", F.get(fits, F.lit(0))["rule_pos"]).drop("_rules")


def form_policy_holds(conditions: Column, fields: Column, size: Column) -> Column:
    """Whether a form upload meets all conditions of its policy: array<struct<op, field, value>> with eq,
    starts-with and content-length-range (value low,high). Anything else is malformed and fails."""

    def one(c: Column) -> Column:
        got = F.coalesce(F.try_element_at(fields, F.regexp_replace(F.lower(c["field"]), r"^\$", "")), F.lit(""))
        low, high = (F.get(F.split(c["value"], ","), F.lit(i)).try_cast("bigint") for i in (0, 1))
        return F.coalesce(
            F.when(c["op"] == "eq", got == c["value"]).when(c["op"] == "starts-with", F.startswith(got, c["value"])).when(c["op"] == "content-length-range", size.between(low, high)),
            F.lit(False),
        )

    return F.forall(conditions, one)
