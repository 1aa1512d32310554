"""A bounded, deterministic sample of labelled texts, from which the classifiers are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fold, texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, bound: int, most_bytes: int = 48 << 20) -> list[tuple[bytes, int]]:
    """At most ``bound`` (text as UTF-8, label) rows, those of least xxhash64(doc_id), outside the held-out fold.

    Together they have ``most_bytes`` at most: a text that would pass that is left out whole, and shorter ones after it still count.

    Rows whose id or label is null, or whose label is neither 0 nor 1, are not learned from. Several labels of one id count
    as their majority, 1 at a tie. Several documents of one id are each a row of the sample (``bound`` holds for them too).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", mod) != held))
    own = own.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # the bound that makes the broadcast below safe
    rows = texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", F.col("text").cast("binary").alias("t"), "y")
    keyed = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("t").alias("th"), F.octet_length("t").alias("n"), "t", "y")
    sizes = keyed.select("h", "doc_id", "th", "n").orderBy("h", "doc_id", "th").limit(bound).collect()  # numbers only
    if sum(r.n for r in sizes) <= most_bytes:
        got = keyed.orderBy("h", "doc_id", "th").limit(bound).select("t", "y")
    else:
        left, fit = most_bytes, []
        for r in sizes:
            if r.n <= left:
                left -= r.n
                fit.append((r.doc_id, r.th))
        few = docs.sparkSession.createDataFrame(fit, "doc_id long, th long")
        got = keyed.join(F.broadcast(few), ["doc_id", "th"], "left_semi").orderBy("h", "doc_id", "th").limit(bound).select("t", "y")
    return [(bytes(t), int(y)) for t, y in got.toLocalIterator()]
