"""Where results go: JSON, a page, frames of an event stream, tables of runs, exports for encoders, and shards of sources."""

from __future__ import annotations

import dataclasses
import html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.dense import content_hash

#: Repositories by short name that a public service may be asked about (A10). Fixed values.
CATALOGUE = (("opencode", "anomalyco/opencode"), ("strapi", "strapi/strapi"), ("outline", "outline/outline"), ("hoppscotch", "hoppscotch/hoppscotch"), ("ripgrep", "BurntSushi/ripgrep"))


def as_json(result: object) -> str:
    """A result of the library as one JSON object."""
    return json.dumps(dataclasses.asdict(result), ensure_ascii=False, default=str)


def page(title: str, result: object) -> str:
    """A page of its own with the result inside (S15): nothing in the data can end its script."""
    data = json.dumps(dataclasses.asdict(result), ensure_ascii=False, default=str)
    for mark in ("<", ">", "&", "\u2028", "\u2029"):
        data = data.replace(mark, f"\\u{ord(mark):04x}")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><pre id="out"></pre><script>const data = {data};\ndocument.getElementById("out").textContent = JSON.stringify(data, null, 1);</script>'


def frames(trace: DataFrame) -> DataFrame:
    """(run, seq, frame): an event-stream frame for each event (S17). Columns: run, seq, type, payload as JSON."""
    data = F.concat(F.lit('{"type":'), F.to_json(F.array("type")).substr(F.lit(2), F.length(F.to_json(F.array("type"))) - 2), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    return trace.select("run", "seq", F.concat(F.lit("event: "), "type", F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))


def stream_frames(trace: DataFrame, send: Callable[[str], None], checkpoint: str):
    """The same of a stream: each batch's frames in order to ``send``; the query is returned. Batches are what a person's run emits."""

    def each(batch: DataFrame, _: int) -> None:
        for r in frames(batch).orderBy("run", "seq").toLocalIterator():
            send(r.frame)

    return trace.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def tree_json(tree: DataFrame) -> DataFrame:
    """(path, node): each node as JSON without its signature, its children by name."""
    own = tree.where("path <> ''")
    below = own.groupBy(F.col("parent").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "name"))), lambda x: x["name"]).alias("children"))
    rows = tree.join(below, "path", "left")
    return rows.select("path", F.to_json(F.struct("name", "kind", "size", "files", F.coalesce("children", F.array().cast("array<string>")).alias("children"))).alias("node"))


def shard(path: Column) -> Column:
    """Two hexadecimal digits that say in which of 256 shards a source lies."""
    return F.substring(F.sha2(path, 256), 1, 2)


def write_shards(files: DataFrame, folder: str) -> None:
    """Sources in 256 folders by shard; a shard's rows come together first, so each has few files."""
    files.withColumn("shard", shard(F.col("path"))).repartition(64, "shard").write.mode("overwrite").partitionBy("shard").parquet(folder)


def export_corpus(files: DataFrame, queries: DataFrame, folder: str) -> None:
    """Files and queries as JSON lines with the hash of each text, for an encoder elsewhere (S23). Columns: path, text; query, text."""
    files.select("path", "text", content_hash(F.col("path"), F.coalesce("text", F.lit(""))).alias("hash")).write.mode("overwrite").json(f"{folder}/files")
    queries.write.mode("overwrite").json(f"{folder}/queries")


def import_vectors(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(path, vector) that an encoder gave for these very texts (S23): those of another text, by hash, are an error."""
    got = spark.read.schema("path string, hash string, vector array<float>").json(path)
    own = files.select("path", content_hash(F.col("path"), F.coalesce("text", F.lit(""))).alias("own"))
    rows = got.join(own, "path", "left")
    same = F.when(F.coalesce(F.col("hash") == F.col("own"), F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("another text: "), "path")).cast("boolean"))
    return rows.where(same).select("path", "vector")


def persist(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """Raw rows and their summary, the rows first, so that a summary never stands without them."""
    rows.write.mode("overwrite").json(f"{folder}/rows")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "name string, repository string")


def prepare(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A retrieval set (JSON, compressed or not) as files (corpus, path, text) and tasks (corpus, task, query, relevant).

    The set maps languages to repositories, each with ``repo``, ``content`` (path to text) and ``needles`` (name, path, description).
    Paths that leave a repository are an error.
    """
    from sextant.functions.text import safe_path

    schema = "map<string,array<struct<repo:string,content:map<string,string>,needles:array<struct<name:string,path:string,description:string>>>>>"
    root = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("root")).select(F.explode("root").alias("language", "repos")).select("language", F.explode("repos").alias("r"))
    corpora = root.select(F.concat_ws("/", "language", "r.repo").alias("corpus"), "r")
    files = corpora.select("corpus", F.explode("r.content").alias("path", "text"))
    files = files.where(F.when(safe_path(F.col("path")), True).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), "path")).cast("boolean")))
    tasks = corpora.select("corpus", F.explode("r.needles").alias("n")).select("corpus", F.concat_ws("#", "corpus", "n.name").alias("task"), F.col("n.description").alias("query"), F.array("n.path").alias("relevant"))
    return files, tasks
