"""GitHub's REST responses as typed rows, and reviews as request bodies. Each reader takes responses with one JSON body a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_USER = "struct<id:bigint,login:string,name:string,email:string,avatar_url:string,html_url:string>"
_REPO = f"struct<id:bigint,name:string,full_name:string,owner:{_USER},private:boolean,html_url:string,clone_url:string,default_branch:string,language:string,description:string>"
_BRANCH = f"struct<ref:string,sha:string,label:string,user:{_USER},repo:{_REPO}>"
_FILE = "struct<filename:string,status:string,additions:int,deletions:int,changes:int,patch:string,blob_url:string,raw_url:string,contents_url:string,previous_filename:string>"
_COMMIT = f"struct<sha:string,message:string,commit:struct<message:string>,author:{_USER},committer:{_USER},html_url:string,files:array<{_FILE}>,parents:array<struct<sha:string>>>"
_PULL = (
    f"struct<id:bigint,number:int,title:string,body:string,state:string,user:{_USER},html_url:string,diff_url:string,patch_url:string,head:{_BRANCH},base:{_BRANCH},merged:boolean,mergeable:boolean,merged_by:{_USER},"
    "commits:int,additions:int,deletions:int,changed_files:int,labels:array<struct<name:string>>>"
)
_COMMENT = f"struct<id:bigint,body:string,user:{_USER},html_url:string,path:string,line:int,side:string,commit_id:string,in_reply_to_id:bigint>"
_REVIEW = f"struct<id:bigint,user:{_USER},body:string,state:string,html_url:string,commit_id:string>"
_COMPARED = f"struct<status:string,ahead_by:int,behind_by:int,total_commits:int,commits:array<{_COMMIT}>,files:array<{_FILE}>>"


def _or(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def known_user(user: Column) -> Column:
    """A missing user has id 0 and the login `unknown`."""
    return F.struct(_or(user["id"], 0).alias("id"), _or(user["login"], "unknown").alias("login"), user["name"].alias("name"), user["email"].alias("email"), user["avatar_url"].alias("avatar_url"), user["html_url"].alias("html_url"))


def _read(responses: DataFrame, schema: str, body: str, many: bool) -> DataFrame:
    """One row for each record: bodies hold one each, or a list of them. Bodies that are no JSON give none."""
    if many:
        return responses.select(F.explode(F.from_json(F.col(body), f"array<{schema}>")).alias("r"))
    return responses.select(F.from_json(F.col(body), schema).alias("r")).where("r is not null and to_json(r) <> '{}'")


def _file(f: Column) -> Column:
    plain = ("patch", "blob_url", "raw_url", "contents_url", "previous_filename")
    return F.struct(f["filename"].alias("filename"), _or(f["status"], "modified").alias("status"), *[_or(f[n], 0).alias(n) for n in ("additions", "deletions", "changes")], *[f[n].alias(n) for n in plain])


def files(responses: DataFrame, body: str = "body", many: bool = True) -> DataFrame:
    """(filename, status, additions, deletions, changes, patch, ...) of a pull request's or a commit's files."""
    return _read(responses, _FILE, body, many).select(_file(F.col("r")).alias("f")).select("f.*")


def _repository(r: Column) -> Column:
    return F.struct(r["id"].alias("id"), r["name"].alias("name"), r["full_name"].alias("full_name"), known_user(r["owner"]).alias("owner"), _or(r["private"], False).alias("private"), r["html_url"].alias("html_url"), r["clone_url"].alias("clone_url"), _or(r["default_branch"], "main").alias("default_branch"), r["language"].alias("language"), r["description"].alias("description"))


def repositories(responses: DataFrame, body: str = "body", many: bool = False) -> DataFrame:
    return _read(responses, _REPO, body, many).select(_repository(F.col("r")).alias("x")).select("x.*")


def branches(responses: DataFrame, body: str = "body", many: bool = False) -> DataFrame:
    """(ref, sha, label, user, repo): ref and sha are empty where they are missing."""
    b = F.col("r")
    return _read(responses, _BRANCH, body, many).select(_or(b["ref"], "").alias("ref"), _or(b["sha"], "").alias("sha"), b["label"].alias("label"), b["user"].alias("user"), F.when(b["repo"].isNotNull(), _repository(b["repo"])).alias("repo"))


def _commit(c: Column) -> Column:
    """The author only where it has an id."""
    return F.struct(
        c["sha"].alias("sha"), F.coalesce(c["commit"]["message"], c["message"], F.lit("")).alias("message"), F.when(_or(c["author"]["id"], 0) != 0, c["author"]).alias("author"), c["committer"].alias("committer"), c["html_url"].alias("html_url"),
        F.transform(F.coalesce(c["files"], F.array()), _file).alias("files"), F.transform(F.coalesce(c["parents"], F.array()), lambda p: p["sha"]).alias("parents"),
    )


def commits(responses: DataFrame, body: str = "body", many: bool = False) -> DataFrame:
    return _read(responses, _COMMIT, body, many).select(_commit(F.col("r")).alias("x")).select("x.*")


def pull_state(state: Column, merged: Column) -> Column:
    return F.when(_or(merged, False), "merged").when(state == "closed", "closed").otherwise("open")


def pull_requests(responses: DataFrame, body: str = "body", many: bool = False) -> DataFrame:
    """One row for each pull request; merged goes before closed before open, missing counts are 0."""
    p = F.col("r")
    place = lambda b: F.struct(_or(b["ref"], "").alias("ref"), _or(b["sha"], "").alias("sha"))
    return _read(responses, _PULL, body, many).select(
        p["id"].alias("id"), p["number"].alias("number"), p["title"].alias("title"), p["body"].alias("body"), pull_state(p["state"], p["merged"]).alias("state"), known_user(p["user"]).alias("user"), p["html_url"].alias("html_url"), place(p["head"]).alias("head"), place(p["base"]).alias("base"),
        _or(p["merged"], False).alias("merged"), p["mergeable"].alias("mergeable"), p["merged_by"].alias("merged_by"), *[_or(p[n], 0).alias(n) for n in ("commits", "additions", "deletions", "changed_files")], F.transform(F.coalesce(p["labels"], F.array()), lambda x: x["name"]).alias("labels"),
    )


def comments(responses: DataFrame, body: str = "body", many: bool = True) -> DataFrame:
    c = F.col("r")
    return _read(responses, _COMMENT, body, many).select(c["id"].alias("id"), _or(c["body"], "").alias("body"), known_user(c["user"]).alias("user"), *[c[n].alias(n) for n in ("html_url", "path", "line", "side", "commit_id", "in_reply_to_id")])


def reviews(responses: DataFrame, body: str = "body", many: bool = True) -> DataFrame:
    r = F.col("r")
    return _read(responses, _REVIEW, body, many).select(r["id"].alias("id"), known_user(r["user"]).alias("user"), r["body"].alias("body"), _or(r["state"], "COMMENTED").alias("state"), r["html_url"].alias("html_url"), r["commit_id"].alias("commit_id"))


def comparisons(responses: DataFrame, body: str = "body") -> DataFrame:
    """(status, ahead_by, behind_by, total_commits, commits, files) of two compared commits."""
    r = F.col("r")
    return _read(responses, _COMPARED, body, False).select(r["status"].alias("status"), *[_or(r[n], 0).alias(n) for n in ("ahead_by", "behind_by", "total_commits")], F.transform(F.coalesce(r["commits"], F.array()), _commit).alias("commits"), F.transform(F.coalesce(r["files"], F.array()), _file).alias("files"))


def review_requests(verdicts: DataFrame, found: DataFrame, key: str, file_key: str) -> DataFrame:
    """(key, request): the JSON body that submits each verdict: summary, event and comments with path, line and body (left out where there are none)."""
    one = F.struct(F.col("new_line").alias("line"), F.col(file_key).cast("string").alias("path"), F.col("body"))
    lists = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: F.struct(c["path"].alias("path"), c["line"].alias("line"), c["body"].alias("body"))).alias("comments"))  # one for each broken rule
    body = F.to_json(F.struct(F.col("summary").alias("body"), F.col("status").alias("event"), "comments"))
    return verdicts.join(lists, key, "left").select(key, body.alias("request"))
