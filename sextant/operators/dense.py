"""Dense retrieval over given vectors: windows of tokens, cosine, best chunk of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WINDOW, OVERLAP = 192, 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or has no length."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def token_windows(tokens: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Overlapping windows that hold every token (L16); the last one ends with the text."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(tokens, i + 1, size)))


#: Queries that are broadcast at once; more go in blocks.
BLOCK = 4096


def rank_files(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, file, score, rank: a file scores as its best chunk (L18). Queries are a stated set: at most BLOCK meet the chunks at once."""
    n = max(1, -(-queries.count() // BLOCK))
    own = queries.select("query", F.col("embedding").alias("q"), norm(F.col("embedding")).alias("nq"))
    rows = chunks.withColumn("nc", norm(F.col("embedding")))
    out = None
    for i in range(n):
        block = own if n == 1 else own.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i)
        pairs = rows.crossJoin(F.broadcast(block))
        length = F.col("nc") * F.col("nq")
        cos = F.coalesce(F.when(length > 0, dot(F.col("embedding"), F.col("q")) / length), F.lit(0.0))
        best = pairs.groupBy("query", "file").agg(F.round(F.max(cos), 5).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file"))).where(F.col("rank") <= k)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of parts with their lengths, so that no two lists of parts run together."""
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def unit(vector: Column) -> Column:
    """A vector at length 1, as encoders give them; one without length stays."""
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector)


def chunk_texts(units: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(path, chunk, text) for an encoder: every window of a unit's words after its path (L17). A unit without words has its path alone."""
    windows = token_windows(F.filter(F.split("body", r"\s+"), lambda w: w != ""), size, overlap)
    texts = F.when(F.size(windows) == 0, F.array(F.lit(""))).otherwise(F.transform(windows, lambda w: F.array_join(w, " ")))
    return units.select("path", F.posexplode(texts).alias("chunk", "text")).select("path", "chunk", F.rtrim(F.concat_ws(" ", "path", "text")).alias("text"))


def input_faults(chunks: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """fault and how many rows have it (V3): repeated queries, vectors of another size, without length, or with what isn't a number."""
    both = chunks.select(F.col("embedding").alias("v")).unionAll(queries.select("embedding"))
    counts = both.agg(F.count_if(F.coalesce(F.size("v"), F.lit(-1)) != size).alias("another size"), F.count_if(norm(F.col("v")) == 0).alias("no length"), F.count_if(F.exists("v", lambda x: x.isNull() | F.isnan(x))).alias("not a number"))
    again = queries.groupBy("query").count().where("count > 1").agg(F.count("*").alias("repeated queries"))
    row = counts.crossJoin(again)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in row.columns])).alias("x")).select("x.fault", "x.n")
