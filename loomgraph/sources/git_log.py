"""Commits of a working copy. Git is asked on the driver, which is where the repository is."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(ord, subject, files) of all commits but merges, newest first. A shallow clone is refused, as two of one
    commit may differ; so is what isn't a repository."""

    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        if done.returncode:
            raise ValueError(f"no git history at {root}: {done.stderr.strip()[:200]}")
        return done.stdout

    if git("rev-parse", "--is-shallow-repository").strip() == "true":
        raise ValueError(f"{root} is a shallow clone: its history depends on how it was cloned")
    rows, n = [], 0
    for entry in git("log", "--no-merges", "--name-only", "--pretty=format:%x1e%s").split("\x1e")[1:]:
        subject, *files = entry.strip("\n").split("\n")
        rows.append((n, subject, [f for f in files if f]))
        n += 1
    return spark.createDataFrame(rows, "ord int, subject string, files array<string>")
