"""Webhook events: JSON to typed rows, signatures, dispatch, and changed files."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "action string, ref string, before string, after string, repository struct<id:bigint,full_name:string,default_branch:string>, sender struct<id:bigint,login:string>, "
    "pull_request struct<number:int,title:string,state:string,merged:boolean,head:struct<sha:string>,base:struct<ref:string>>, "
    "commits array<struct<id:string,message:string,added:array<string>,modified:array<string>,removed:array<string>>>, repositories array<struct<full_name:string>>"
)
_KNOWN = ("push", "pull_request", "installation", "installation_repositories", "issue_comment", "ping")


def parse(events: DataFrame, kind: str = "event_type", body: str = "payload") -> DataFrame:
    """events with `event` (unknown kinds are push), `data` (typed payload; NULL where it is no JSON) and `state`: merged before closed before open."""
    data = F.from_json(F.col(body), PAYLOAD)
    out = events.withColumn("event", F.when(F.col(kind).isin(*_KNOWN), F.col(kind)).otherwise("push")).withColumn("data", data)
    pr = F.col("data.pull_request")
    return out.withColumn("state", F.when(pr.isNull(), None).when(F.coalesce(pr["merged"], F.lit(False)), "merged").when(pr["state"] == "closed", "closed").otherwise("open"))


def changed_files(parsed: DataFrame, key: str) -> DataFrame:
    """(key, file): distinct files that the event's commits added, modified or removed."""
    commits = F.col("data.commits")
    paths = F.flatten(F.transform(commits, lambda c: F.flatten(F.array(*[F.coalesce(c[x], F.array().cast("array<string>")) for x in ("added", "modified", "removed")]))))
    return parsed.select(key, F.explode(F.array_distinct(paths)).alias("file"))


def dispatch(kind: Column, action: Column) -> Column:
    """The first handler that takes the event."""
    reviewed = action.isin("opened", "synchronize", "reopened")
    return F.when(kind == "push", "push").when((kind == "pull_request") & reviewed, "pull_request").when(kind.isin("installation", "installation_repositories"), "installation").otherwise("No handler")


def valid_signature(body: Column, signature: Column, secret: str | None) -> Column:
    """`sha256=` + HMAC of the body, compared in constant time; false without a secret or a signature."""

    @F.pandas_udf("boolean")
    def check(b: pd.Series, s: pd.Series) -> pd.Series:
        if not secret:
            return pd.Series(False, index=b.index)
        return pd.Series([x is not None and y is not None and hmac.compare_digest("sha256=" + hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest(), y) for x, y in zip(b, s, strict=True)], index=b.index)

    return check(body, signature)
