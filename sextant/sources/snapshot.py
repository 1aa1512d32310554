"""Files as tables, snapshots of an index with their checks, and loaders of retrieval sets."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.lexical import FIELDS, Index

# Fixed values.
VERSION, MOST_BYTES = 1, 2 << 20


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (from the folder), size and text of regular files; texts of 1 byte to 2 MiB without NULs near the start, else null."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://", 1)[-1].rstrip("/") + "/"
    path = F.element_at(F.split("path", re.escape(root)), -1)
    text = F.decode("content", "UTF-8")
    small = F.col("length").between(1, MOST_BYTES)
    return rows.select(path.alias("path"), F.col("length").alias("size"), F.when(small & ~F.substring(text, 1, 8192).contains("\0"), text).alias("text")).where(T.safe_path(F.col("path")))


#: Endings of texts that are read, and names that are read without one.
READ = frozenset(".astro .bash .c .cc .cfg .conf .cpp .cs .css .csv .cts .env .go .gql .graphql .h .hpp .htm .html .ini .java .js .json .jsonc .jsx .kt .less .md .mdx .mjs .mts .php .prisma .proto .py .rb .rs .sass .scss .sh .sql .svelte .swift .toml .ts .tsx .txt .vue .xml .yaml .yml .zsh".split())
READ_NAMES = ("dockerfile", "makefile", "gemfile", "rakefile", "procfile")
#: Endings of data: their names are indexed and their contents are not.
DATA = (".json", ".jsonc", ".csv", ".xml")
MOST_KEYS = 64


def readable(path: Column) -> Column:
    """Whether a file's name is one of a text that is read (S3)."""
    name = F.lower(T.base_name(path))
    return T.ext_of(name).isin(*sorted(READ)) | F.regexp_extract(name, r"^([^.]*)", 1).isin(*READ_NAMES)


def lexical_fields(units: DataFrame) -> DataFrame:
    """(path, sig, body, keys) as the index takes it (S9): data has no body, and with over MOST_KEYS keys no signature either."""
    data = T.ext_of(T.base_name(F.col("path"))).isin(*DATA)
    many = data & (F.size("keys") > MOST_KEYS)
    return units.select("path", F.when(many, "").otherwise(F.coalesce("sig", F.lit(""))).alias("sig"), F.when(data, "").otherwise(F.coalesce("body", F.lit(""))).alias("body"))


def file_window(files: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last of each file, and how many there are."""
    lines = F.split("text", "\n")
    return files.select("path", F.slice(lines, max(1, first), max(0, last - max(1, first) + 1)).alias("lines"), F.size(lines).alias("total"))


def save(index: Index, edges: DataFrame, path: str) -> None:
    """A folder of Parquet tables and their version."""
    for name, df in (("postings", index.postings), ("doc_stats", index.doc_stats), ("edges", edges)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    edges.sparkSession.createDataFrame([(VERSION,)], "version int").write.mode("overwrite").json(f"{path}/_meta")


def load(spark: SparkSession, path: str) -> tuple[Index, DataFrame]:
    version = spark.read.schema("version int").json(f"{path}/_meta").first()
    if version is None or version[0] != VERSION:
        raise ValueError(f"snapshot of version {version and version[0]}; this reads {VERSION}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    index, edges = Index(read("postings"), read("doc_stats")), read("edges")
    bad = {r.check: r.n for r in integrity(index, edges).collect() if r.n}
    if bad:
        raise ValueError(f"broken snapshot: {bad}")
    return index, edges


def integrity(index: Index, edges: DataFrame) -> DataFrame:
    """check and how many rows break it: all must be 0 (V1)."""
    docs = index.doc_stats.select("path")
    # Dealt out before they are grouped, so that a task never groups all postings that it reads; a number keeps the parts from being put together.
    parts = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.postings.select("path", "term").repartition(parts, "path", "term")
    # One pass over the postings: per path they are few enough to meet the documents.
    held = index.postings.groupBy("path").agg(F.count("*").alias("n"), *[F.sum(f"tf_{f}").alias(f"s_{f}") for f in FIELDS])
    met = held.join(index.doc_stats.withColumn("known", F.lit(True)), "path", "left")
    above = F.expr(" OR ".join(f"s_{f} > len_{f}" for f in FIELDS))
    both = met.agg(F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("postings without a document"), F.count_if(above).alias("counts above lengths"))
    checks = {
        "repeated paths": docs.groupBy("path").count().where("count > 1"),
        "unsafe paths": docs.where(~T.safe_path(F.col("path"))),
        "repeated postings": dealt.groupBy("path", "term").count().where("count > 1"),
        "edges without an end": edges.select(F.explode(F.array("from", "to")).alias("path")).distinct().join(docs, "path", "left_anti"),
        "loops": edges.where(F.col("from") == F.col("to")),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), [*counts, both.unpivot([], both.columns, "check", "n")])


def patch_paths(patch: str) -> list[str]:
    """Old-side paths that a git diff touches, renamed ones by their old name, new files left out."""
    out: list[str] = []
    for part in re.split(r"(?m)^diff --git ", patch)[1:]:
        moved = re.search(r"(?m)^rename from (.+)$", part)
        old = re.search(r"(?m)^--- (.+?)\t?$", part)
        name = moved[1] if moved else old[1] if old else None
        if name is None:
            head = re.match(r'("(?:[^"\\]|\\.)*"|\S+) ', part)
            name = head[1] if head and "new file mode" not in part else None
        if name is None or name == "/dev/null":
            continue
        if name.startswith('"'):
            raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t"}.get(m[1], m[1]), name[1:-1].encode())
            name = raw.decode("utf-8", "replace")
        out.append(name.removeprefix("a/") if not moved else name)
    return list(dict.fromkeys(out))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|specs?|testing)(/|$)|(^|/)(test_[^/]*|[^/]*[_.](test|spec))\.[^/.]+$|(^|/)conftest\.py$")


def relevant_paths(patches: DataFrame, files: DataFrame) -> DataFrame:
    """task, path of files that a patch changes, that were there before, and that aren't tests (S22). Columns: task, patch; task, path."""
    split = F.udf(patch_paths, "array<string>")
    touched = patches.select("task", F.explode(split("patch")).alias("path"))
    return touched.where(~is_test_path(F.col("path"))).join(files.select("task", "path"), ["task", "path"], "left_semi").distinct()


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Issues with their patches, from a JSON array or from JSON lines; rows without a required field fail."""
    schema = "instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string"
    head = spark.read.text(path, wholetext=True).select(F.ltrim(F.substring("value", 1, 200))).first()
    rows = spark.read.schema(schema).option("multiLine", bool(head and head[0].startswith("["))).option("mode", "FAILFAST").json(path)
    need = [F.col(c).isNotNull() for c in ("instance_id", "repo", "base_commit", "problem_statement", "patch")]
    ok = reduce(lambda a, b: a & b, need)
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("an instance lacks a field")).cast("boolean")))


def manifest(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Tasks (corpus, task, query) and relevant paths (task, path) of a retrieval manifest."""
    root = json.loads(text)
    tasks = [(c["id"], t["id"], t["query"]) for c in root["corpora"] for t in c["tasks"]]
    rels = [(t["id"], p) for c in root["corpora"] for t in c["tasks"] for p in t["relevant"]]
    return spark.createDataFrame(tasks, "corpus string, task string, query string"), spark.createDataFrame(rels, "task string, path string")
