"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in DataFrame functions only.

A paragraph is what stands between line feeds, and its leaves are pieces of it, cut where the text itself says so. A leaf's node is the
SHA-256 of its bytes with its length beside it; a paragraph's node hashes its leaves' nodes. A section ends after an empty paragraph, or
after a paragraph whose node begins with 0 or 1 (one in eight), so sections find their places again after an edit; its node hashes its
paragraphs' nodes. The root hashes the sections' nodes. Equal roots mean equal texts; where roots differ, differing sections and then
differing paragraphs in them give the place of an edit. Likeness compares the leaves' nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A leaf ends at a space after one of these letters or marks.
LEAF_END = "(?<=[ent.!?]) "
#: A leaf over LONG characters (no such space: figures, CJK, minified text) is cut again after these characters, about one in ten.
LONG, INNER_END = 400, "(?<=[05afkqAFKQ/,\u3001\u3002\uff0c\u7684\u306e])"
#: About so many documents of one range of ids. Beyond RANGES of these, ranges hold more: they are sorted and read as streams, so a
#: large one spills and takes longer, and nothing else changes.
RANGE_DOCS, RANGES = 512, 1 << 16
LEAST = -(1 << 63)
HEX = 64


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _leaf(x: Column) -> Column:
    return F.concat(F.sha2(x, 256), F.length(x).cast("string"))


def leaf_nodes(text: Column) -> Column:
    """Array of a string for each paragraph: its leaves' nodes (64 hex digits and the length) joined by blanks; '+' begins the
    further pieces of a long leaf."""

    def of(paragraph: Column) -> Column:
        leaves = F.split(paragraph, LEAF_END, -1)
        cut = F.transform(leaves, lambda x: F.when(F.length(x) <= LONG, _leaf(x)).otherwise(F.array_join(F.transform(F.split(x, INNER_END, -1), _leaf), " +")))
        return F.array_join(cut, " ")

    return F.transform(paragraphs(text), of)


def paragraph_nodes(leaves: Column) -> Column:
    return F.transform(leaves, lambda x: F.sha2(x, 256))


def sections(nodes: Column) -> Column:
    """Over an array of paragraph nodes: an array of the sections, each its paragraphs' nodes in a row."""
    empty = F.sha2(_leaf(F.lit("")), 256)
    marked = F.transform(nodes, lambda h: F.when((h == empty) | F.substring(h, 1, 1).isin("0", "1"), F.concat(h, F.lit("/"))).otherwise(h))
    return F.split(F.rtrim(F.array_join(marked, ""), F.lit("/")), "/", -1)


def root(sections_: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections_, lambda s: F.sha2(s, 256)), ""), 256)


def fingerprint(text: Column) -> Column:
    """Root of a text's tree, lowercase hex."""
    return root(sections(paragraph_nodes(leaf_nodes(text))))


def leaf_set(leaves: Column) -> Column:
    """The distinct leaf nodes of a tree."""
    return F.array_distinct(F.split(F.array_join(leaves, " "), " \\+?", -1))


def weight(nodes: Column) -> Column:
    """Of leaf nodes: the characters below them, and one for each."""
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda a, x: a + F.substring(x, HEX + 1, 12).cast("long") + 1)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of two sets of leaf nodes: characters under those of both over characters under those of either; 1 only for equal roots."""
    both = weight(F.array_intersect(a, b))
    return F.when(same, F.lit(1.0)).otherwise(F.least(both / (weight(a) + weight(b) - both), F.lit(0.999999)))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.size(a))


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """How many last elements two arrays share beyond their common prefix."""
    return F.least(common_prefix(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - prefix)


def children(sections_: Column, begin: Column, n: Column) -> Column:
    """Paragraph nodes of ``n`` sections from place ``begin`` (from 0) on."""
    return F.regexp_extract_all(F.array_join(F.slice(sections_, begin + 1, F.greatest(n, F.lit(0))), ""), F.lit("[0-9a-f]{64}"), F.lit(0))


def edits(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Descends from the roots of two trees (columns ``a`` and ``b``: their sections) to the branches that differ. Adds, as places in
    ``a``: first_section and n_sections that differ, and in these first_paragraph and n_paragraphs that differ; null for equal trees.
    Where the edit is an insertion a count is 0, and the place is where it stands."""
    rows = rows.withColumn("sp", common_prefix(F.col(a), F.col(b)))
    rows = rows.withColumn("ss", common_suffix(F.col(a), F.col(b), F.col("sp")))
    own, other = (children(F.col(c), F.col("sp"), F.size(c) - F.col("sp") - F.col("ss")) for c in (a, b))
    above = F.when(F.col("sp") > 0, F.length(F.array_join(F.slice(F.col(a), F.lit(1), F.col("sp")), "")) / HEX).otherwise(0).cast("long")
    rows = rows.withColumn("ca", own).withColumn("cb", other)
    rows = rows.withColumn("pp", common_prefix(F.col("ca"), F.col("cb")))
    rows = rows.withColumn("ps", common_suffix(F.col("ca"), F.col("cb"), F.col("pp")))
    differ = ~((F.size(a) == F.size(b)) & (F.col("sp") == F.size(a)))
    found = {"first_section": F.col("sp"), "n_sections": F.size(a) - F.col("sp") - F.col("ss"), "first_paragraph": above + F.col("pp"), "n_paragraphs": F.size("ca") - F.col("pp") - F.col("ps")}
    return rows.withColumns({k: F.when(differ, v.cast("long")) for k, v in found.items()}).drop("sp", "ss", "ca", "cb", "pp", "ps")


def _place(key: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` ascending bounds are not above the key, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the row that follows in ascending doc_id order; after the last the first.

    Null ids come first, rows of one id in order of their texts, a null text is empty. Rows are dealt by ranges of ids between their
    quantiles (so wherever the ids lie, a range has about RANGE_DOCS documents) and the first row of each range goes to the range
    before it too, so no task sees more than a range. Bounds and heads are a number for each range. Rows of one id stay together.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = own.withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    n = own.count()
    ranges = max(1, min(-(-n // RANGE_DOCS), RANGES))
    cuts = sorted(set(own.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or [])) if ranges > 1 else []
    bounds = F.from_json(F.lit(str(cuts)), "array<bigint>")  # folded to one literal
    keyed = keyed.withColumn("range", _place(F.col("key"), bounds, len(cuts)))
    heads = sorted(keyed.groupBy("range").agg(F.min("key").alias("key")).collect())  # at most RANGES + 1 rows
    halo = spark.createDataFrame([(h.key, heads[i - 1].range) for i, h in enumerate(heads)], "key long, before int")
    dealt = keyed.join(F.broadcast(halo), "key", "left").select(
        "doc_id", "key", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))))).alias("at")
    )
    order = Window.partitionBy("at.range").orderBy("at.copy", "key", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where(~F.col("at.copy")).select("doc_id", "text", "next_text")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, how alike they and the next document's are, and where the edit is.

    Null texts are empty ones; an empty table gives no rows; repeated rows each give one; columns other than doc_id and text are
    ignored; very long texts are one tree each, whole. A lone document is its own next one.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited")
    )
    rows = rows.select("*", *[leaf_nodes(F.col(c)).alias(f"{c}_leaves") for c in ("text", "edited", "next_text")])
    rows = rows.select("*", *[paragraph_nodes(F.col(f"{c}_leaves")).alias(f"{c}_nodes") for c in ("text", "edited")])
    rows = rows.select("*", *[sections(F.col(f"{c}_nodes")).alias(f"{c}_sections") for c in ("text", "edited")], *[leaf_set(F.col(f"{c}_leaves")).alias(f"{c}_set") for c in ("text", "edited", "next_text")])
    rows = rows.select("*", *[root(F.col(f"{c}_sections")).alias(f"{c}_root") for c in ("text", "edited")], (F.col("text_leaves") == F.col("next_text_leaves")).alias("same_next"))
    rows = edits(rows, "text_sections", "edited_sections")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("text_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("text_set"), F.col("edited_set"), F.col("text_root") == F.col("edited_root")).alias("near_edited"),
        likeness(F.col("text_set"), F.col("next_text_set"), F.col("same_next")).alias("near_next"),
        F.size("text_sections").cast("long").alias("n_sections"),
        F.size("text_nodes").cast("long").alias("n_paragraphs"),
        F.col("first_section").alias("first_edited_section"),
        F.col("n_sections").alias("edited_sections"),
        F.col("first_paragraph").alias("first_edited_paragraph"),
        F.col("n_paragraphs").alias("edited_paragraphs"),
    )
