"""A git working copy as snapshots and change sets: a driver-side connector; rows go on as DataFrames."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.discovery import change_type


class Repository:
    """Commands run in the working copy with a time limit; a failing one raises CalledProcessError."""

    def __init__(self, path: str, timeout: int = 120):
        self.path, self.timeout = path, timeout

    @classmethod
    def clone(cls, url: str, path: str, *, timeout: int = 300, **options) -> Repository:
        """Options are git's own, such as branch and depth."""
        more = [x for k, v in options.items() if v for x in (f"--{k}", str(v))]
        subprocess.run(["git", "clone", *more, url, path], check=True, capture_output=True, timeout=timeout)
        return cls(path)

    def run(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.path, *args], check=True, capture_output=True, text=True, timeout=self.timeout).stdout

    def is_repository(self) -> bool:
        try:
            return self.run("rev-parse", "--is-inside-work-tree").strip() == "true"
        except (subprocess.SubprocessError, OSError):
            return False

    def pull(self) -> None:
        self.run("pull", "--ff-only")

    def head(self) -> str:
        return self.run("rev-parse", "HEAD").strip()

    def default_branch(self) -> str:
        try:
            return self.run("symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip().split("/", 1)[-1]
        except subprocess.CalledProcessError:
            return self.run("rev-parse", "--abbrev-ref", "HEAD").strip()

    def timestamp(self, commit: str = "HEAD") -> datetime:
        return datetime.fromtimestamp(int(self.run("show", "-s", "--format=%ct", commit).strip()), timezone.utc)

    def content(self, path: str, commit: str = "HEAD") -> str | None:
        """The file's text in the commit; None where it isn't there."""
        try:
            return self.run("show", f"{commit}:{path}")
        except subprocess.CalledProcessError:
            return None

    def exists(self, path: str, commit: str = "HEAD") -> bool:
        return subprocess.run(["git", "-C", self.path, "cat-file", "-e", f"{commit}:{path}"], capture_output=True, timeout=self.timeout).returncode == 0

    def snapshot(self, spark: SparkSession, commit: str = "HEAD") -> DataFrame:
        """(path, hash) of all files of the commit; the hash is the blob's."""
        rows = [(line.split("\t", 1)[1], line.split()[2]) for line in self.run("-c", "core.quotePath=off", "ls-tree", "-r", commit).splitlines()]
        return spark.createDataFrame(rows, "path string, hash string")

    def _changes(self, spark: SparkSession, *args: str) -> DataFrame:
        rows = []
        for line in self.run("-c", "core.quotePath=off", "diff", "--name-status", "-M", *args).splitlines():
            letter, *paths = line.split("\t")
            rows.append((paths[-1], letter, paths[0] if letter[0] == "R" else None))
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, "path string, letter string, old_path string").select("path", change_type(F.col("letter")).alias("change"), "old_path")

    def diff(self, spark: SparkSession, old: str, new: str = "HEAD") -> DataFrame:
        """(path, change, old_path) between commits; git decides what is a rename."""
        return self._changes(spark, old, new)

    def uncommitted(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(staged, unstaged, untracked)."""
        rest = spark.createDataFrame([(p,) for p in self.run("ls-files", "--others", "--exclude-standard").splitlines()], "path string")
        return self._changes(spark, "--cached"), self._changes(spark), rest
