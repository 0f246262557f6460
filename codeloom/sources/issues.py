"""Issues from a folder of JSON files, `<number>.json` each."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

ISSUE = "number string, title string, body string, labels array<string>, url string, metadata map<string,string>, _broken string"


def issues(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(source, number, title, body, labels, url, metadata, broken); missing keys have defaults, a file's metadata go before repo."""
    read = spark.read.schema(ISSUE).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(root, pathGlobFilter="*.json")
    return normalised(read.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("stem")), repo)


def read_lines(lines: DataFrame, repo: str) -> DataFrame:
    """What `issues` gives, from (stem, value): one JSON object a row."""
    parsed = F.from_json("value", ISSUE, {"columnNameOfCorruptRecord": "_broken"})
    return normalised(lines.select("stem", parsed.alias("i")).select("stem", "i.*"), repo)


def normalised(read: DataFrame, repo: str) -> DataFrame:
    """Rows of ISSUE and stem, the number that stands for a missing one, with the defaults of missing keys."""
    stem = F.col("stem")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    given = F.map_filter(F.create_map(F.lit("repo"), F.lit(repo)), lambda k, v: ~F.map_contains_key(own, "repo"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    labels = F.coalesce("labels", F.array().cast("array<string>")).alias("labels")
    return read.select(F.lit("local").alias("source"), stem.alias("file_number"), F.coalesce("number", stem).alias("number"), blank("title"), blank("body"), labels, "url", F.map_concat(given, own).alias("metadata"), F.col("_broken").isNotNull().alias("broken"))


def fetch(spark: SparkSession, root: str, repo: str, number: int | str) -> Row:
    if not (Path(root) / f"{number}.json").is_file():
        raise EngineError(f"no issue {number} in {root}")
    row = issues(spark, f"{root}/{number}.json", repo).first()
    if row is None or row.broken:
        raise EngineError(f"issue {number} in {root} is no JSON object")
    return row
