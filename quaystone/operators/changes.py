"""Changes: an old table and a batch of requests give the new table.

Each is a join on the key that rewrites matched rows, so a batch of any size is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.meta import copied_metadata
from quaystone.functions.requests import append_outcome
from quaystone.operators import multipart, snapshot, versions
from quaystone.sources.sinks import last_of_each, put_objects

KEY = ["bucket", "key"]


def _rewrite(table: DataFrame, requests: DataFrame, keys: list[str], order: Sequence[str] = (), **new: Column) -> DataFrame:
    """Rows that a request names get new values; ``new`` may use the request's columns as r.name. The last request of a key counts."""
    r = last_of_each(requests, keys, *order).alias("r")
    hit = F.col("r." + keys[0]).isNotNull()
    out = table.alias("t").join(r, [F.col(f"t.{k}") == F.col(f"r.{k}") for k in keys], "left")
    return out.select(*[(F.when(hit, new[c]).otherwise(F.col(f"t.{c}")) if c in new else F.col(f"t.{c}")).alias(c) for c in table.columns])


def set_tags(objects: DataFrame, requests: DataFrame, now: str, *order: str) -> DataFrame:
    """requests: bucket, key, tags (null deletes them). Also refreshes mod_time, as the store does."""
    return _rewrite(objects, requests, KEY, order, user_tags=F.col("r.tags"), mod_time=F.lit(now).cast("timestamp_ntz"))


def set_retention(log: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """requests: bucket, key, version_id, mode, until, bypass. Changes that the present lock forbids are ignored."""
    ok = versions.retention_allowed(F.col("t.lock_mode"), F.col("t.retain_until"), F.col("r.mode"), F.col("r.until"), F.col("r.bypass"), F.lit(now).cast("timestamp_ntz"))
    ok = F.coalesce(ok, F.lit(True))
    return _rewrite(
        log, requests, [*KEY, "version_id"], (),
        lock_mode=F.when(ok, F.col("r.mode")).otherwise(F.col("t.lock_mode")), retain_until=F.when(ok, F.col("r.until")).otherwise(F.col("t.retain_until")),
    )


def copy_objects(objects: DataFrame, requests: DataFrame, now: str, *order: str) -> DataFrame:
    """requests: bucket, key (the source), to_bucket, to_key, directive, user_meta. Missing sources copy nothing; of several
    copies to one key the last by ``order`` stays (else by the source's name)."""
    requests = last_of_each(requests, ["to_bucket", "to_key"], *(order or KEY))
    r = requests.withColumnRenamed("user_meta", "new_meta")
    found = objects.join(r, KEY)
    made = found.withColumn("user_meta", copied_metadata(F.col("directive"), F.col("user_meta"), F.col("new_meta"))).withColumn("mod_time", F.lit(now).cast("timestamp_ntz"))
    made = made.withColumn("bucket", F.col("to_bucket")).withColumn("key", F.col("to_key")).select(*objects.columns)
    return put_objects(objects, made)


def append(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Each append (bucket, key, offset, content) with its outcome and, if it may go on, the new content."""
    have = objects.select(*KEY, F.col("content").alias("old"))
    rows = requests.join(have, KEY, "left")
    rows = rows.withColumn("outcome", append_outcome(F.octet_length("old"), F.col("offset"), F.octet_length("content")))
    new = F.concat(F.coalesce("old", F.lit(b"")), "content")
    return rows.withColumn("new_content", F.when(F.col("outcome") == "ok", new)).drop("old")


def complete_upload(objects: DataFrame, uploads: DataFrame, parts: DataFrame, request: DataFrame, now: str) -> DataFrame:
    """Objects after the requested uploads complete: those whose parts all pass become objects, the rest change nothing."""
    checked = multipart.validate(request, parts)
    good = checked.groupBy("upload_id").agg(F.bool_and(F.col("outcome") == "ok").alias("ok")).where("ok").select("upload_id")
    wanted = parts.join(request.select("upload_id", "part_number"), ["upload_id", "part_number"], "left_semi").join(good, "upload_id", "left_semi")
    made = multipart.complete(wanted).join(uploads, "upload_id").withColumn("mod_time", F.lit(now).cast("timestamp_ntz"))
    return put_objects(objects, made.select(*[c for c in objects.columns if c in made.columns], "upload_id"), "upload_id")


def new_uploads(uploads: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Uploads after a batch of new ones (bucket, key, nonce): each gets an id of its own from what asks for it."""
    made = requests.select(*KEY, F.sha2(F.concat_ws("/", *KEY, F.col("nonce").cast("string"), F.lit(now)), 256).alias("upload_id"), F.lit(now).cast("timestamp_ntz").alias("initiated"))
    return uploads.withColumn("upload_id", F.col("upload_id").cast("string")).unionByName(made, allowMissingColumns=True)


def put_parts(parts: DataFrame, uploads: DataFrame, requests: DataFrame, *order: str) -> DataFrame:
    """Parts after a batch of part uploads; those of unknown uploads are refused, a number that comes again replaces its part."""
    made = requests.join(uploads.select("upload_id").distinct(), "upload_id", "left_semi")
    made = last_of_each(made, ["upload_id", "part_number"], *order)
    names = ["upload_id", "part_number"]
    kept = parts.join(made.select(*names), names, "left_anti").select(*parts.columns)
    return kept.unionByName(made.select(*[c for c in parts.columns if c in made.columns]), allowMissingColumns=True)


def copy_parts(parts: DataFrame, uploads: DataFrame, objects: DataFrame, requests: DataFrame) -> DataFrame:
    """As put_parts, each part a byte range (start, length; null for all) of an object's content. Missing sources copy nothing."""
    found = requests.join(objects.select(*KEY, "content"), KEY)
    start = F.coalesce("start", F.lit(0)).cast("int")
    piece = F.substring(F.col("content"), start + 1, F.coalesce("length", F.octet_length("content") - start).cast("int"))
    made = found.withColumn("content", piece).withColumn("size", F.octet_length("content").cast("bigint")).withColumn("etag", F.md5("content"))
    return put_parts(parts, uploads, made.select("upload_id", "part_number", "size", "etag"), "etag")


def tiered_content(objects: DataFrame, remote: DataFrame) -> DataFrame:
    """The bytes of a read with a range (start, length; null for all): from the tier that an object names (remote: tier,
    tier_key, content), else its own; null if the tier lacks them."""
    far = remote.select("tier", "tier_key", F.col("content").alias("_far"))
    rows = objects.join(far, ["tier", "tier_key"], "left")
    whole = F.when(F.col("tier").isNotNull(), F.col("_far")).otherwise(F.col("content"))
    start = F.coalesce("start", F.lit(0)).cast("int")
    return rows.withColumn("body", F.substring(whole, start + 1, F.coalesce("length", F.octet_length(whole) - start).cast("int"))).drop("_far")


def remove_prefix(objects: DataFrame, bucket: str, prefix: str) -> DataFrame:
    """Objects after a recursive delete; a prefix that ends in no slash also takes the key itself."""
    return objects.where((F.col("bucket") != bucket) | ~F.startswith("key", F.lit(prefix)))


def abort_uploads(uploads: DataFrame, parts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return uploads.join(ids, "upload_id", "left_anti"), parts.join(ids, "upload_id", "left_anti")


def restore(log: DataFrame, manifest: DataFrame, now: str) -> DataFrame:
    """The log after a snapshot's restore: changed and deleted keys get their old content as a new version, keys made
    since get a delete marker."""
    plan = snapshot.diff(manifest, versions.heads(log))
    back = plan.where("action = 'restore'").select(*KEY, F.col("was").alias("version_id"))
    old = log.join(back, [*KEY, "version_id"]).withColumn("version_id", F.md5(F.concat_ws("\x00", "version_id", F.lit(now)))).withColumn("mod_time", F.lit(now).cast("timestamp_ntz"))
    return versions.delete(versions.put(log, old.select(*log.columns)), plan.where("action = 'remove'"), now)


def move_set(log: DataFrame, plan: DataFrame) -> DataFrame:
    """All versions of moved keys, markers and locks included, on their new set."""
    return _rewrite(log, plan, KEY, set_idx=F.col("r.target"))


def lifecycle_rows(configs: DataFrame) -> DataFrame:
    """Rules from a bucket's XML document: a filter's prefix comes before the rule's own, no status means enabled."""
    schema = "struct<Rule:array<struct<ID:string,Status:string,Prefix:string,Filter:struct<Prefix:string>,Expiration:struct<Days:int,Date:string>,NoncurrentVersionExpiration:struct<NoncurrentDays:int>,AbortIncompleteMultipartUpload:struct<DaysAfterInitiation:int>,Transition:struct<Days:int,StorageClass:string>>>>"
    rows = configs.select("bucket", F.posexplode(F.from_xml("document", schema)["Rule"]).alias("rule_pos", "r"))
    return rows.select(
        "bucket", "rule_pos", F.col("r.ID").alias("id"), F.coalesce("r.Filter.Prefix", "r.Prefix", F.lit("")).alias("prefix"), F.coalesce("r.Status", F.lit("Enabled")).alias("status"),
        F.col("r.Expiration.Days").alias("expiration_days"), F.try_to_timestamp("r.Expiration.Date").cast("timestamp_ntz").alias("expiration_date"),
        F.col("r.NoncurrentVersionExpiration.NoncurrentDays").alias("noncurrent_days"), F.col("r.AbortIncompleteMultipartUpload.DaysAfterInitiation").alias("abort_mpu_days"),
        F.col("r.Transition.Days").alias("transition_days"), F.col("r.Transition.StorageClass").alias("transition_tier"),
    )


def merge_secrets(old_rules: DataFrame, new_rules: DataFrame, mask: str = "********") -> DataFrame:
    """New replication rules; a masked secret keeps the one that the rule of this id had."""
    had = old_rules.select("bucket", "id", F.col("secret").alias("_old"))
    kept = F.when(F.col("secret") == mask, F.col("_old")).otherwise(F.col("secret"))
    return new_rules.join(had, ["bucket", "id"], "left").withColumn("secret", kept).drop("_old")


def change_identities(people: DataFrame, changes: DataFrame) -> DataFrame:
    """People after a batch of changes: op put adds or replaces a row of this access key, op remove drops it.
    Of several changes of one key the last counts: by the column ``place`` if there is one."""
    changes = last_of_each(changes, ["access_key"], *(c for c in changes.columns if c == "place"))
    rest = people.join(changes.select("access_key"), "access_key", "left_anti").select(*people.columns)
    return rest.unionByName(changes.where("op = 'put'").select(*people.columns))


def lock_granted(answers: DataFrame, nodes: int) -> DataFrame:
    """Whether enough nodes granted a lock request: more than half."""
    counts = answers.groupBy("resource", "token").agg(F.count_if("granted").alias("grants"))
    return counts.withColumn("held", F.col("grants") >= nodes // 2 + 1)


def owner_or_found(objects: DataFrame, seen: DataFrame, hash_owner: Column) -> DataFrame:
    """The set that holds each object: the one its key hashes to if it was seen there, else the first other one."""
    rows = objects.withColumn("_hashed", hash_owner).join(seen, KEY, "left")
    there = F.max(F.when(F.col("set_idx") == F.col("_hashed"), F.col("set_idx")))
    return rows.groupBy(*KEY).agg(F.coalesce(there, F.min("set_idx")).alias("set_idx"))
