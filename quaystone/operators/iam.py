"""Access: identities, policy documents, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.globs import any_glob, glob_match, in_cidr
from quaystone.operators.lifecycle import small

STATEMENT = "policy string, stmt_pos int, effect string, principals array<string>, actions array<string>, not_actions array<string>, resources array<string>, conditions map<string,map<string,array<string>>>"

# Canned policies.
READ_ACTIONS = ["s3:GetObject", "s3:GetObjectVersion", "s3:ListBucket", "s3:ListAllMyBuckets", "s3:GetBucketLocation", "s3:ListBucketMultipartUploads", "s3:ListMultipartUploadParts"]
WRITE_ACTIONS = ["s3:PutObject", "s3:AbortMultipartUpload", "s3:ListMultipartUploadParts", "s3:ListBucketMultipartUploads", "s3:GetBucketLocation"]
DIAGNOSTIC_ACTIONS = ["admin:ServerInfo", "admin:StorageInfo", "admin:HealthInfo"]
EVERYTHING = "arn:aws:s3:::*"
CANNED = {
    "readwrite": [["s3:*"]],
    "readonly": [READ_ACTIONS],
    "writeonly": [WRITE_ACTIONS],
    "diagnostics": [DIAGNOSTIC_ACTIONS],
    "consoleAdmin": [["s3:*"], ["admin:*"]],
}


def canned_policies(spark: SparkSession) -> DataFrame:
    rows = [(name, i, "Allow", None, actions, None, [EVERYTHING], None) for name, docs in CANNED.items() for i, actions in enumerate(docs)]
    return spark.createDataFrame(rows, STATEMENT)


def parse_policies(docs: DataFrame) -> DataFrame:
    """Statements of policy documents (columns policy, document): a string where an array may stand counts as one element."""
    as_list = lambda c: F.when(F.substring(F.trim(c), 1, 1) == "[", F.from_json(c, "array<string>")).otherwise(F.when(c.isNotNull(), F.array(c)))
    schema = "struct<Statement:array<struct<Effect:string,Principal:string,Action:string,NotAction:string,Resource:string,Condition:map<string,map<string,string>>>>>"
    rows = docs.select("policy", F.posexplode(F.from_json("document", schema)["Statement"]).alias("stmt_pos", "s"))
    principal = F.get_json_object("s.Principal", "$.AWS")
    return rows.select(
        "policy", "stmt_pos", F.col("s.Effect").alias("effect"), as_list(F.coalesce(principal, F.col("s.Principal"))).alias("principals"),
        as_list(F.col("s.Action")).alias("actions"), as_list(F.col("s.NotAction")).alias("not_actions"), as_list(F.col("s.Resource")).alias("resources"),
        F.transform_values("s.Condition", lambda _, kv: F.transform_values(kv, lambda _, v: as_list(v))).alias("conditions"),
    )


def principal_matches(principals: Column, account: Column) -> Column:
    """No principals at all, a star, the account itself, or a name that ends in it."""
    one = lambda p: (p == "*") | (p == account) | F.endswith(p, F.concat(F.lit("/"), account)) | F.endswith(p, F.concat(F.lit(":"), account))
    return principals.isNull() | (F.size(principals) == 0) | F.exists(principals, one)


def action_matches(actions: Column, not_actions: Column, action: Column) -> Column:
    given = not_actions.isNotNull() & (F.size(not_actions) > 0)
    return F.when(given, ~any_glob(not_actions, action)).otherwise(any_glob(actions, action))


def resource_matches(resources: Column, bucket: Column, obj: Column) -> Column:
    """Patterns without their ARN part against bucket/object, or the bare bucket; none given matches all."""
    name = F.when(F.coalesce(obj, F.lit("")) == "", bucket).otherwise(F.concat(bucket, F.lit("/"), obj))
    bare = F.transform(resources, lambda r: F.regexp_replace(r, "^arn:aws:s3:::", ""))
    return resources.isNull() | (F.size(resources) == 0) | any_glob(bare, name)


def condition_holds(op: Column, got: Column, want: Column) -> Column:
    """One operator on a key's values. Unknown operators hold; StringLike holds without a value, the negated ones too."""
    hit = lambda test: F.exists(got, lambda g: F.exists(want, lambda w: test(g, w)))
    equal, ip = hit(lambda g, w: g == w), hit(in_cidr)
    return (
        F.when(op == "StringEquals", equal).when(op == "StringNotEquals", ~equal).when(op == "StringEqualsIgnoreCase", hit(lambda g, w: F.lower(g) == F.lower(w)))
        .when(op == "StringLike", hit(lambda g, w: glob_match(w, g)) | (F.size(got) == 0)).when(op == "IpAddress", ip).when(op == "NotIpAddress", ~ip).otherwise(True)
    )


def conditions_hold(conditions: Column, account: Column, ip: Column, values: Column) -> Column:
    def got(key: Column) -> Column:
        other = F.coalesce(F.try_element_at(values, key), F.array().cast("array<string>"))
        return F.when(key == "aws:username", F.array(account)).when(key == "aws:SourceIp", F.array(ip)).otherwise(other)

    each = lambda e: F.forall(F.map_entries(e["value"]), lambda kv: condition_holds(e["key"], got(kv["key"]), kv["value"]))
    return conditions.isNull() | F.forall(F.map_entries(conditions), each)


def statement_matches(statement: Column | None = None, account: str = "access_key", action: str = "action", bucket: str = "bucket", obj: str = "object", ip: str = "source_ip", values: str = "condition_values") -> Column:
    """Over rows that hold a request and a statement: in columns of their own, or as the struct ``statement``."""
    of = F.col if statement is None else (lambda name: statement[name])
    return (
        principal_matches(of("principals"), F.col(account)) & action_matches(of("actions"), of("not_actions"), F.col(action))
        & resource_matches(of("resources"), F.col(bucket), F.col(obj)) & conditions_hold(of("conditions"), F.col(account), F.col(ip), F.col(values))
    )


def _by_key(grants: DataFrame, statements: DataFrame) -> DataFrame:
    """access_key and its policies: an array with an array of statements for each. A key has some dozens at most."""
    fields = [c for c in statements.columns if c not in ("policy", "stmt_pos")]
    each = statements.groupBy("policy").agg(F.collect_list(F.struct(*fields)).alias("statements"))
    return grants.join(small(each), "policy").groupBy("access_key").agg(F.collect_list("statements").alias("_policies"))


def decide(requests: DataFrame, grants: DataFrame, statements: DataFrame, strict_deny: bool = False) -> DataFrame:
    """Adds ``allowed`` to requests (request_id, access_key, action, bucket, object, source_ip, condition_values).

    grants names the policies of each access key. Inside one policy a deny wins; across policies any that allows
    is enough, unless ``strict_deny``. A request meets its key's policies in one row and is decided there: no group by
    request, and no shuffle of requests while the keys' policies are few enough to be broadcast.
    """
    rows = requests.join(small(grants.select("access_key", "policy").distinct().transform(lambda g: _by_key(g, statements))), "access_key", "left")
    hit = lambda p, effect: F.exists(p, lambda s: (s["effect"] == effect) & statement_matches(s))
    allowed = F.exists("_policies", lambda p: hit(p, "Allow") & ~hit(p, "Deny"))
    if strict_deny:
        allowed = allowed & ~F.exists("_policies", lambda p: hit(p, "Deny"))
    return rows.withColumn("allowed", F.coalesce(allowed, F.lit(False))).select(*requests.columns, "allowed")


def bucket_policy_decision(iam_allowed: Column, bucket_allows: Column, bucket_denies: Column) -> Column:
    """An identity's allow comes first; else the bucket's own policy decides."""
    return iam_allowed | (F.coalesce(bucket_allows, F.lit(False)) & ~F.coalesce(bucket_denies, F.lit(False)))


def identities(keys: DataFrame, users: DataFrame, services: DataFrame, sessions: DataFrame, root: str, now: str) -> DataFrame:
    """Who an access key is: root, a user, a service account or a live session, in this order, with the policies that hold.

    Service accounts and sessions have their parent's policies; a parent that is root makes them root.
    """
    u = users.select(F.col("access_key"), F.col("policies").alias("u_policies"), F.lit(True).alias("is_user"))
    s = services.select("access_key", F.col("parent").alias("s_parent"))
    live = sessions.where(F.col("expiry") > F.lit(now).cast("timestamp_ntz")).select("access_key", F.col("parent").alias("t_parent"))
    out = keys.join(u, "access_key", "left").join(s, "access_key", "left").join(live, "access_key", "left")
    parent = F.when(F.col("is_user"), F.lit(None)).otherwise(F.coalesce("s_parent", "t_parent"))
    parents = users.select(F.col("access_key").alias("parent"), F.col("policies").alias("p_policies"))
    out = out.withColumn("parent", parent).join(parents, "parent", "left")
    is_root = (F.col("access_key") == root) | (F.coalesce("parent", F.lit("")) == root)
    kind = F.when(F.col("access_key") == root, "root").when(F.col("is_user"), "user").when(F.col("s_parent").isNotNull(), "service").when(F.col("t_parent").isNotNull(), "session")
    return out.select("access_key", kind.alias("kind"), "parent", is_root.alias("is_root"), F.coalesce("u_policies", "p_policies").alias("policies")).where("kind IS NOT NULL")


def effective_policies(people: DataFrame, custom: DataFrame, canned: DataFrame) -> DataFrame:
    """Statements that hold for each access key; a custom policy hides a canned one of its name."""
    shown = canned.join(custom.select("policy").distinct(), "policy", "left_anti").unionByName(custom)
    return people.select("access_key", F.explode("policies").alias("policy")).join(small(shown), "policy")
