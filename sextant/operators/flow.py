"""Charts of how units work together: seeds, windows of evidence, the cut to nodes and edges, and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as T

# Fixed values.
ROLES = ("ui", "client", "entrypoint", "guard", "handler", "service", "config", "persistence", "external", "test")
SEEDS, SEEDS_EACH, EXPAND, DRAW = 20, 6, 0.7, 0.5
NODES, EDGES, CARRIES, FLIP = 36, 64, 0.35, 0.4
EVIDENCE, EVIDENCE_LEAST, PLUMBING = 3, 0.7, 0.6


def role_rank(role: Column) -> Column:
    """Stage of a role, from 0; an unknown one comes last."""
    at = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)
    return F.when(at > 0, at - 1).otherwise(len(ROLES)).cast("int")


def seeds(members: DataFrame) -> DataFrame:
    """Strong members, a few of each cluster, the best of all (W1). Columns: path, cluster, score."""
    each = Window.partitionBy("cluster").orderBy(F.desc("score"), "path")
    own = members.where(F.col("score") >= EXPAND).withColumn("k", F.row_number().over(each)).where(F.col("k") <= SEEDS_EACH)
    return own.orderBy(F.desc("score"), "path").limit(SEEDS).select("path", "cluster", "score")


def expand(frontier: DataFrame, edges: DataFrame, judged: DataFrame, fan_out: int = 40) -> DataFrame:
    """One hop (W3): new units next to the frontier, each claimed by the frontier's first unit that reaches it, so many for each.

    ``frontier``: path, place. Type-only edges and judged units are left out. A claim comes before the cap, as in the order of places.
    """
    both = edges.where("not type_only").select(F.col("from").alias("a"), F.col("to").alias("b"), "line").unionAll(edges.where("not type_only").select("to", "from", "line"))
    near = both.join(frontier.withColumnRenamed("path", "a"), "a").join(judged.select(F.col("path").alias("b")), "b", "left_anti")
    first = near.groupBy("b").agg(F.min(F.struct("place", "line", "a")).alias("k"))
    order = Window.partitionBy("k.a").orderBy("k.line", "b")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fan_out).select(F.col("b").alias("path"), F.col("k.a").alias("claimed_by"))


def terminal(units: DataFrame, threshold: Column) -> DataFrame:
    """Units that end an expansion: hubs and plumbing."""
    return units.withColumn("terminal", (F.col("fan_in") > threshold) | (F.col("plumbing") >= PLUMBING))


def windows(lines: DataFrame, radius: int = 2) -> DataFrame:
    """path, first, last, best of each island of lines whose windows touch (W5). Columns: path, line, score."""
    order = Window.partitionBy("path").orderBy("line")
    rows = lines.withColumn("new", (F.col("line") - F.coalesce(F.lag("line").over(order), F.lit(-1_000_000)) > 2 * radius + 1).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order))
    return rows.groupBy("path", "island").agg(F.greatest(F.min("line") - radius, F.lit(1)).cast("int").alias("first"), (F.max("line") + radius).cast("int").alias("last"), F.max("score").alias("best")).drop("island")


def titles(paths: DataFrame) -> DataFrame:
    """Last names; where two units share one, with the folder before."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    n = F.count("*").over(Window.partitionBy(name))
    return paths.select("path", F.when(n > 1, F.regexp_extract("path", "([^/]*/[^/]*|[^/]*)$", 1)).otherwise(name).alias("title"))


def cut_nodes(judged: DataFrame) -> DataFrame:
    """What is drawn: parts, seeds first, then by score (W9). Columns: path, part, seed, role."""
    kept = judged.where(F.col("part") >= DRAW).orderBy(F.desc("seed"), F.desc("part"), "path").limit(NODES)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("seed"), F.desc("part"), "path")))


def cut_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between drawn nodes that carry enough or are an end's only one, turned where a handler imports its guard."""
    ends = nodes.select("path", "role", "role_confidence")
    own = edges.join(ends.select(F.col("path").alias("from"), F.col("role").alias("fr"), F.col("role_confidence").alias("fc")), "from").join(ends.select(F.col("path").alias("to"), F.col("role").alias("tr"), F.col("role_confidence").alias("tc")), "to")
    degree = own.select(F.explode(F.array("from", "to")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    joined = own.join(degree.select(F.col("node").alias("from"), F.col("degree").alias("df")), "from").join(degree.select(F.col("node").alias("to"), F.col("degree").alias("dt")), "to")
    kept = joined.where((F.col("carries") >= CARRIES) | (F.col("df") == 1) | (F.col("dt") == 1))
    flip = (F.col("fr") == "handler") & (F.col("tr") == "guard") & (F.col("fc") >= FLIP) & (F.col("tc") >= FLIP)
    turned = kept.select(F.when(flip, F.col("to")).otherwise(F.col("from")).alias("from"), F.when(flip, F.col("from")).otherwise(F.col("to")).alias("to"), "carries", flip.alias("flipped"))
    return turned.orderBy(F.desc("carries"), "from", "to").limit(EDGES)


#: Words of a path that tell a role offline, first match first.
ROLE_WORDS = {
    "test": "test|tests|spec|fixture|mock", "config": "config|settings|env|constants", "guard": "auth|guard|middleware|permission|session|policy", "persistence": "db|database|model|models|store|storage|repository|migration|schema|sql|cache",
    "handler": "handler|handlers|route|routes|router|controller|endpoint|webhook", "ui": "ui|view|views|page|pages|component|components|screen|widget", "client": "client|sdk|fetch|request|http", "entrypoint": "main|index|cli|app|server|cmd|bin",
}


def roles(paths: DataFrame) -> DataFrame:
    """``paths`` with role and role_confidence as the stand-in judge gives them: by the words of the path, else a service."""
    words = T.split_ident(F.regexp_replace("path", r"\.[^./]*$", ""))
    role = F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, w.split("|")))), F.lit(r)) for r, w in ROLE_WORDS.items()])
    return paths.withColumn("role", F.coalesce(role, F.lit("service"))).withColumn("role_confidence", F.when(role.isNull(), 0.3).otherwise(0.6))


def carries(edges: DataFrame) -> DataFrame:
    """``edges`` with what the stand-in says they carry: more names, more weight; uses of types alone carry little."""
    return edges.withColumn("carries", F.when(F.col("type_only"), 0.2).otherwise(F.least(F.lit(1.0), 0.4 + 0.15 * F.size("names"))))


def summary_text(block: Column) -> Column:
    """First sentence of a comment block without its anchor line (W18). A block is an array of lines, an anchor begins with an arrow."""
    return T.first_sentence(F.array_join(F.filter(block, lambda x: ~x.startswith("→")), " "))


# Endings by the mark of their comments. Fixed values.
HASHES = ("py", "sh", "bash", "zsh", "rb", "yml", "yaml", "toml", "env")
DASHES = ("sql", "lua", "hs")


def comment_lines(lines: Column, ext: Column) -> Column:
    """Of each line: what it says as a comment, or null where it isn't one (T20). Block comments run on to their end."""
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        t = F.trim(line)
        by_line = F.when(t.startswith("#!"), "").when(ext.isin(*HASHES), F.when(t.startswith("#"), F.regexp_replace(t, r"^#+\s?", ""))).when(ext.isin(*DASHES), F.when(t.startswith("--"), F.regexp_replace(t, r"^-+\s?", "")))
        slashes = ~ext.isin(*HASHES, *DASHES) & ~t.startswith("#!")
        opens = slashes & ~a["on"] & t.rlike(r"^\{?/\*")
        inside = F.trim(F.regexp_replace(F.regexp_replace(t, r"^\{?/?\*+\s?", ""), r"\*/.*$", ""))
        said = F.when(~slashes, by_line).when(a["on"] | opens, inside).when(t.startswith("//"), F.regexp_replace(t, r"^/+\s?", "")).otherwise(none)
        on = slashes & (a["on"] | opens) & ~t.contains("*/")
        return F.struct(on.alias("on"), F.concat(a["out"], F.array(said)).alias("out"))

    return F.aggregate(lines, start, step)["out"]


def says_nothing(text: Column) -> Column:
    """A divider, a reminder, or code that is commented out."""
    return text.rlike(r"^\s*$|^[-=*#/_~]+$|(?i)^(todo|fixme|hack|xxx)\b") | text.rlike(r"^(import|export|const|let|var|return) |^if \(|^[})({;]")


def comment_blocks(units: DataFrame, most_lines: int = 12) -> DataFrame:
    """(path, line, text): runs of comment lines that say something, each with the first line of code after it as its anchor.

    Runs are islands of neighbouring lines; a run longer than ``most_lines`` keeps its first lines.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    lines = F.split("body", "\n")
    rows = units.select("path", F.posexplode(F.arrays_zip(lines.alias("raw"), comment_lines(lines, ext).alias("said"))).alias("at", "x")).select("path", "at", "x.raw", "x.said")
    order = Window.partitionBy("path").orderBy("at")
    rows = rows.withColumn("code", F.col("said").isNull() & (F.trim("raw") != "")).withColumn("anchor", F.first(F.when(F.col("code"), F.trim("raw")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("island", F.sum(F.col("said").isNull().cast("int")).over(order)).where(F.col("said").isNotNull() & ~says_nothing(F.col("said")))
    runs = rows.groupBy("path", "island").agg((F.min("at") + 1).alias("line"), F.array_sort(F.collect_list(F.struct("at", "said"))).alias("said"), F.max_by("anchor", "at").alias("anchor"))
    said = F.slice(F.transform("said", lambda x: x["said"]), 1, most_lines)
    return runs.select("path", "line", F.when(F.col("anchor").isNull(), said).otherwise(F.concat(said, F.array(F.concat(F.lit("→ "), "anchor")))).alias("text"))


def stages(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Depth of each of at most NODES nodes along edges (U1); an edge that closes a circle, in the order of nodes, doesn't count."""
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        if a in after and b in after and a != b:
            after[a].append(b)
    state: dict[str, int] = {}
    kept: list[tuple[str, str]] = []
    done: list[str] = []

    def visit(n: str) -> None:
        state[n] = 1
        for m in after[n]:
            if state.get(m) != 1:
                kept.append((n, m))
            if m not in state:
                visit(m)
        state[n] = 2
        done.append(n)

    for n in nodes:
        if n not in state:
            visit(n)
    depth = dict.fromkeys(nodes, 0)
    for n in reversed(done):
        for a, b in kept:
            if a == n:
                depth[b] = max(depth[b], depth[a] + 1)
    return depth


def edge_class(from_depth: Column, to_depth: Column) -> Column:
    """How an edge is drawn (U2): to the next stage or beyond it, beside its own stage, or back under the chart."""
    return F.when(to_depth > from_depth, "routed").when(to_depth == from_depth, "side").otherwise("floor")


def spine(parts: dict[str, float], edges: list[tuple[str, str, float]]) -> list[str]:
    """The heaviest chain forward through the stages (U3): each edge gives what it carries times the better part (0.2 at least) of its
    end, each node half its part; ties by path."""
    depth = stages(sorted(parts), [(a, b) for a, b, _ in edges])
    best = {n: (0.5 * p, (n,)) for n, p in parts.items()}
    for n in sorted(parts, key=lambda n: (depth[n], n)):
        for a, b, c in sorted(edges):
            if b == n and a in best and depth[a] < depth[b]:
                weight = best[a][0] + c * max(0.2, parts[b]) + 0.5 * parts[b]
                if weight > best[b][0] + 1e-12:
                    best[b] = (weight, (*best[a][1], b))
    return list(max(best.values(), key=lambda x: (round(x[0], 9), [-ord(ch) for ch in x[1][-1]]))[1]) if best else []


def reading_order(nodes: list[dict], edges: list[tuple[str, str]]) -> list[str]:
    """Order of at most NODES drawn nodes (W13): role, then the longest way down edges that don't lead back in role, then path.

    The depth of a node on a circle depends on the order of edges and is capped at the number of nodes, so it is worked out here.
    """
    rank = {n["path"]: ROLES.index(n["role"]) if n["role"] in ROLES else len(ROLES) for n in nodes}
    depth = dict.fromkeys(rank, 0)
    for _ in nodes:
        moved = False
        for a, b in edges:
            if a in rank and b in rank and rank[a] <= rank[b] and depth[b] < depth[a] + 1 <= len(nodes):
                depth[b], moved = depth[a] + 1, True
        if not moved:
            break
    return sorted(rank, key=lambda p: (rank[p], depth[p], p))


def back_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges with whether they lead back in reading order (W14). ``order``: path, place."""
    a, b = (order.select(F.col("path").alias(k), F.col("place").alias(f"{k}_place")) for k in ("from", "to"))
    return edges.join(a, "from").join(b, "to").withColumn("back", F.col("from_place") > F.col("to_place")).drop("from_place", "to_place")


def node_evidence(blocks: DataFrame) -> DataFrame:
    """The best strong blocks of each unit, in order of lines (W15). Columns: path, line, score."""
    best = blocks.where(F.col("score") >= EVIDENCE_LEAST).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "line"))).where(F.col("k") <= EVIDENCE)
    return best.groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def mentions(units: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by a unique file name of eight characters or more in a unit's description, where no edge is."""
    unique = names.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).where(F.length("name") >= 8)
    unique = unique.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n = 1").select(F.col("path").alias("to"), "name")
    told = units.join(unique, F.col("about").contains(F.col("name")) & (F.col("path") != F.col("to"))).select(F.col("path").alias("from"), "to")
    return told.join(edges.select("from", "to"), ["from", "to"], "left_anti")


def chart_summary(nodes: DataFrame, edges: DataFrame, all_nodes: int, all_edges: int) -> DataFrame:
    """One row: drawn, dropped, verdict (W16): found with a node of 0.7 and an edge."""
    both = nodes.agg(F.count("*").alias("nodes"), F.max("part").alias("best")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return both.select("nodes", "edges", (F.lit(all_nodes) - F.col("nodes")).alias("dropped_nodes"), (F.lit(all_edges) - F.col("edges")).alias("dropped_edges"), F.when((F.col("best") >= EXPAND) & (F.col("edges") > 0), "found").otherwise("partial").alias("verdict"))
