"""Where results go and are found again: tables, models with their metadata, reports, settings, feeds."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.cleaning import version_hash
from pitchside.operators.boosting import Trees
from pitchside.operators.learning import Boosted
from pitchside.sources.scratch import cut

SAVED = "sport string, kind string, version string, form string, parts int, metadata string"


def save_table(df: DataFrame, path: str, keys: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Appends df to the Parquet table at path; with keys only rows whose key is not there yet (one writer at a time is meant)."""
    spark = df.sparkSession
    if keys:
        df = df.dropDuplicates(keys)
        if exists(spark, path):
            df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_keys(df: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Puts df into the Parquet table at path, partitioned by a column: a row takes the place of the one with its keys.

    Only the partitions that df touches are written again (dynamic partition overwrite), so a day's metrics
    can be run again or corrected. Of rows of df with equal keys any one is kept; keys hold the partition's
    column. One writer at a time is meant.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        old = spark.read.parquet(path)
        touched = new.select(partition).distinct()
        kept = old.join(touched, partition, "left_semi").join(new.select(*keys), keys, "left_anti")
        new = cut(new.unionByName(kept.select(*df.columns)))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, by Spark's own file listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    try:
        return found.load(path).select("path").limit(1).count() > 0
    except Exception as error:  # Spark has one error class for a path that is not there
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_version(spark: SparkSession, settings: dict[str, Any], rows: int) -> str:
    """Twelve hexadecimal digits of the settings and the number of rows."""
    text = json.dumps(settings, sort_keys=True)
    return spark.range(1).select(version_hash(F.lit(text), F.lit(str(rows))).alias("v")).first()["v"]


def save_model(model: Any, folder: str, sport: str, kind: str, metadata: dict[str, Any]) -> str:
    """Saves a fitted model and its metadata under folder; gives the version.

    A model of trees is stored as its JSON text, boosted pipelines one by one, any other by its own writer.
    The metadata is written last, so what latest_model finds is whole.
    """
    spark = SparkSession.active()
    version = model_version(spark, metadata, int(metadata.get("rows", 0)))
    path = f"{folder}/{sport}_{kind}_{version}"
    form = "trees" if isinstance(model, Trees) else "boosted" if isinstance(model, Boosted) else "pipeline"
    if form == "trees":
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    elif form == "boosted":
        for i, m in enumerate(model.models):
            m.write().overwrite().save(f"{path}/model/{i}")
    else:
        model.write().overwrite().save(f"{path}/model")
    parts = len(model.models) if form == "boosted" else 1
    row = {"sport": sport, "kind": kind, "version": version, "form": form, "parts": parts, "metadata": json.dumps(metadata, sort_keys=True)}
    spark.createDataFrame([row], SAVED).withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return version


def latest_model(spark: SparkSession, folder: str, sport: str, kind: str) -> tuple[Any, dict[str, Any]] | None:
    """The model of a sport and kind that was saved last, with its metadata; None if there is none."""
    rows = spark.read.schema(SAVED + ", saved_at timestamp").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.json").json(folder)
    own = rows.where((F.col("sport") == sport) & (F.col("kind") == kind) & F.col("version").isNotNull() & F.col("form").isNotNull())
    last = own.orderBy(F.desc("saved_at"), F.desc("version")).limit(1).collect()
    if not last:
        return None
    path = f"{folder}/{sport}_{kind}_{last[0]['version']}/model"
    if last[0]["form"] == "trees":
        model = Trees.from_json(spark.read.text(path, wholetext=True).first()["value"])
    elif last[0]["form"] == "boosted":
        model = Boosted([PipelineModel.load(f"{path}/{i}") for i in range(last[0]["parts"])])
    else:
        model = PipelineModel.load(path)
    return model, json.loads(last[0]["metadata"])


def report(df: DataFrame, path: str, form: str = "json") -> None:
    """A report as JSON lines, or as text of 'name: value' pairs, one line for each row."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    else:
        lines = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])
        df.select(lines.alias("value")).write.mode("overwrite").text(path)


def settings(spark: SparkSession, path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """Settings of a file of 'key: value' lines, nested by two blanks for each level, over defaults.

    Keys are joined by dots. A file that is not there gives the defaults; values are numbers where they
    look like numbers, true and false, else texts.
    """
    lines = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("text")) if path else None
    found: dict[str, Any] = {}
    above: list[str] = []
    for text in [r["text"] for r in lines.collect()] if lines is not None else []:  # one small file
        for line in text.splitlines():
            body = line.split("#", 1)[0].rstrip()
            if ":" not in body:
                continue
            depth = (len(body) - len(body.lstrip())) // 2
            key, _, value = (x.strip() for x in body.partition(":"))
            above = [*above[:depth], key]
            if value:
                found[".".join(above)] = _typed(value.strip("'\""))
    return defaults | found


def _typed(value: str) -> Any:
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def feed(spark: SparkSession, path: str, keywords: list[str], row_tag: str = "entry") -> DataFrame:
    """Entries of Atom feeds in files whose title or summary holds one of the keywords (of three letters or more).

    title, link, snippet (no tags, 300 characters at most) and the file's name.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("title string, summary string, link struct<_href:string>").load(path)
    rows = rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    snippet = F.left(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]+>", "")), F.lit(300))
    words = [k.lower() for k in keywords if len(k) >= 3]
    text = F.lower(F.concat_ws(" ", "title", snippet))
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)
    return rows.where(hit).select("title", F.col("link._href").alias("link"), snippet.alias("snippet"), "source_file")
