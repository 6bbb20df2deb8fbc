"""Exported review-thread pages: one nested record per pull request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = (
    "repo string, pr struct<number:int,url:string,baseRefOid:string,headRefOid:string,"
    "comments:array<struct<author:string,body:string>>,"
    "threads:array<struct<id:string,isOutdated:boolean,path:string,originalLine:int,originalStartLine:int,diffSide:string,"
    "comments:array<struct<author:string,body:string,url:string,originalCommit:string>>>>,"
    "threads_truncated:boolean>")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def explode_threads(pages: DataFrame) -> DataFrame:
    """One row per thread with its pull request fields and first comment."""
    return (pages.select("repo", "pr.number", "pr.url", "pr.baseRefOid", "pr.headRefOid", F.explode("pr.threads").alias("t"))
            .select("repo", F.col("number").alias("pr"), F.col("url").alias("pr_url"), F.col("baseRefOid").alias("base_ref_oid"),
                    F.col("headRefOid").alias("head_ref_oid"), F.col("t.id").alias("thread_id"), F.col("t.isOutdated").alias("is_outdated"),
                    F.col("t.path").alias("path"), F.col("t.originalLine").alias("line"), F.col("t.originalStartLine").alias("start_line"),
                    F.col("t.diffSide").alias("diff_side"), F.get("t.comments", F.lit(0)).alias("first")))


def explode_comments(pages: DataFrame) -> DataFrame:
    """Pull request comments: repo, pr, pos, body."""
    return pages.select("repo", F.col("pr.number").alias("pr"), F.posexplode("pr.comments").alias("pos", "c")).select(
        "repo", "pr", "pos", F.col("c.body").alias("body"))
