"""One object over a collection of units: find, map, explain and assess coverage, with a judge of one's choice.

Each verb plans DataFrames and collects only what a person reads: some dozens of rows. The judge is the deterministic stand-in for
an outside model unless another one is given.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import facts, query
from sextant.functions import text as T
from sextant.operators import flow, graph, judge, lexical, navigate, projects, signature, tree
from sextant.sources import snapshot
from sextant.sources.shared import written

# Fixed values.
WHOLE_SCOPE, PREFILTER, KEEP_WALKED, MOST_VERIFIED = 250, 320, 3, 8
RELATIVE_WEIGHT = 0.5


@dataclass
class Result:
    rows: list[dict]
    verdict: str
    stats: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Library:
    """Units (path, text) with everything that is worked out from them, each on first use and written once."""

    def __init__(self, units: DataFrame) -> None:
        self.files = units.select("path", "text")

    @cached_property
    def facts(self) -> DataFrame:
        return written(facts.extract(self.files))

    @cached_property
    def index(self) -> lexical.Index:
        sig = F.concat_ws("\n", "about", F.transform("decls", lambda d: d["name"]), "calls", "strings", "headings", "keys", "tables")
        units = self.files.join(self.facts.select("path", sig.alias("sig"), "keys"), "path", "left").select("path", "sig", F.col("text").alias("body"), "keys")
        built = lexical.build(snapshot.lexical_fields(units))
        return lexical.Index(written(built.postings), written(built.doc_stats))

    @cached_property
    def tree(self) -> DataFrame:
        return written(tree.nodes(self.files.select("path", F.coalesce(F.length("text"), F.lit(0)).alias("size"))))

    @cached_property
    def resolved(self) -> DataFrame:
        uses = self.facts.select(F.col("path").alias("from"), F.explode("imports").alias("i")).select("from", F.col("i.spec").alias("spec"), F.col("i.names").alias("names"), F.col("i.how").alias("how"), F.col("i.type_only").alias("type_only"), F.col("i.line").alias("line"))
        return written(uses.join(projects.resolve_all(self.files, uses), ["from", "spec"]))

    @cached_property
    def edges(self) -> DataFrame:
        """References between units, names followed through barrels to where they are declared."""
        found = self.resolved.where("kind = 'file'").withColumnRenamed("path", "to").select("from", "to", "names", "type_only", "how", "line")
        declared = self.facts.select("path", F.explode("decls").alias("d")).select("path", F.col("d.name").alias("name"))
        return written(graph.merge(graph.through_barrels(projects.landed(found, self.files, declared), declared)))

    @cached_property
    def signatures(self) -> DataFrame:
        n = self.index.doc_stats.count()
        rarity = lexical.vocabulary(self.index).select(F.col("term").alias("word"), lexical.idf(F.lit(n), F.col("df")).alias("rarity"))
        return written(signature.signatures(self.facts, rarity))

    def terms(self, question: str, extra: list[tuple[str, float]] = ()) -> list[lexical.Term]:
        forms = self.files.sparkSession.createDataFrame([(f,) for f in sorted(query.candidates(question, extra))] or [("",)], "term string")
        known = {r.term for r in self.index.postings.select("term").join(F.broadcast(forms), "term", "left_semi").distinct().collect()}
        return query.parse(known, question, extra)

    def find(self, question: str, scope: str = "", by: judge.Judge | None = None) -> Result:
        """The units that answer: recall by words, a first judgment, verification of the best, a walk where none is good (NAV1)."""
        begin = time.perf_counter()
        terms = self.terms(question)
        by = by or judge.Overlap([t.label for t in terms])
        hits = written(lexical.pool(self.index, terms, scope))
        small = self.files.where(lexical.T.under(F.col("path"), scope)).limit(WHOLE_SCOPE + 1).count() <= WHOLE_SCOPE
        lane = self.files.where(lexical.T.under(F.col("path"), scope)).select("path") if small else hits.select("path")
        judged = written(by.score(self.files.join(lane, "path", "left_semi").withColumn("unit", F.col("path")), "shortlist").select("path", "belief"))
        chosen = navigate.find_candidates(judged, hits).select("path")
        first = self._verify(chosen, by)
        best = first.agg(F.max("score")).first()[0] or 0.0
        rows, warnings = first, []
        if best < judge.FOUND:
            try:
                walked = navigate.walk(self._children(judged)).where("kind = 'file'").orderBy(F.desc("score"), "path").select("path").join(first, "path", "left_anti").limit(KEEP_WALKED)
                rows = navigate.merge_verified(first, self._verify(walked.unionByName(first.where(F.col("score") >= judge.PARTIAL).select("path")).distinct().limit(MOST_VERIFIED), by))
            except (TimeoutError, ConnectionError) as e:  # the first results stand
                warnings.append(str(e))
        got = [r.asDict() for r in rows.orderBy(F.desc("score"), "path").limit(MOST_VERIFIED).collect()]
        top = max((r["score"] for r in got), default=0.0)
        verdict = "found" if top >= judge.FOUND else "partial" if top >= judge.PARTIAL else "absent"
        return Result(got, verdict, {"ms": round(1000 * (time.perf_counter() - begin)), "terms": [t.label for t in terms]}, warnings)

    def run_find(self, question: str, scope: str = "", by: judge.Judge | None = None, walk_only: bool = False) -> Result:
        """``find``, or a bare walk from the root whose best finishers are judged by their text alone (NAV18)."""
        if not walk_only:
            return self.find(question, scope, by)
        by = by or judge.Overlap([t.label for t in self.terms(question)])
        judged = written(by.score(self.files.where(T.under(F.col("path"), scope)).withColumn("unit", F.col("path")), "walk").select("path", "belief"))
        finished = navigate.walk(self._children(judged), beam=MOST_VERIFIED).where("kind = 'file'").orderBy(F.desc("score"), "path").limit(MOST_VERIFIED)
        got = [r.asDict() for r in self._verify(finished.select("path"), by).orderBy(F.desc("score"), F.desc("pick"), "path").collect()]
        top = max((r["score"] for r in got), default=0.0)
        return Result(got, "found" if top >= judge.FOUND else "partial" if top >= judge.PARTIAL else "absent")

    def save(self, path: str) -> None:
        """The index and the graph as a snapshot (A1)."""
        snapshot.save(self.index, self.edges, path)

    @classmethod
    def load(cls, units: DataFrame, path: str) -> "Library":
        """A library whose index and graph come from a snapshot that holds together (A1)."""
        out = cls(units)
        out.index, out.edges = snapshot.load(units.sparkSession, path)
        return out

    def _verify(self, paths: DataFrame, by: judge.Judge) -> DataFrame:
        rows = by.score(self.files.join(paths, "path", "left_semi").withColumn("unit", F.col("path")), "verify")
        rows = written(rows.select("path", "belief"))
        return written(judge.verified(rows, judge.shares(rows, "belief")))

    def _children(self, judged: DataFrame) -> DataFrame:
        """A child's probability is its share of its siblings' heat."""
        warm = tree.heat(judged.withColumnRenamed("belief", "value")).withColumn("heat", F.col("heat") + 0.01)
        rows = self.tree.where("path <> ''").join(warm, "path", "left").withColumn("heat", F.coalesce("heat", F.lit(0.01)))
        total = rows.groupBy("parent").agg(F.sum("heat").alias("all"))
        return rows.join(total, "parent").select("parent", "path", "kind", (F.col("heat") / F.col("all")).alias("p"), F.lit(1.0).alias("under"))

    def map(self, subject: str, scope: str = "", by: judge.Judge | None = None) -> Result:
        """Every unit that belongs to a subject, and how warm each folder is (NAV12)."""
        terms = self.terms(subject)
        typed = [t.label for t in terms]
        near = [lexical.Term(r.term, (r.term,), RELATIVE_WEIGHT) for r in lexical.relatives(lexical.vocabulary(self.index), typed).orderBy("term").limit(64).collect()] if typed else []
        by = by or judge.Overlap(typed)
        named = lexical.search(self.index, terms + near, "path", scope, PREFILTER).select("path")
        told = lexical.search(self.index, terms + near, "all", scope, PREFILTER).select("path")
        judged = written(by.score(self.files.join(named.union(told).distinct(), "path", "left_semi").withColumn("unit", F.col("path")), "member").select("path", "belief"))
        rows = [r.asDict() for r in navigate.map_results(judged).collect()]
        warm = {r.path: r.heat for r in tree.heat(judged.withColumnRenamed("belief", "value"), True).orderBy(F.desc("heat"), "path").limit(navigate.MEMBER_ROWS).collect()}
        return Result(rows, "found" if rows else "absent", {"heat": warm})

    def explain(self, question: str, scope: str = "", by: judge.Judge | None = None, depth: int = 3) -> Result:
        """Units that work together on a subject, with the references between them, in reading order."""
        subject = query.topic(question)
        members = self.map(subject, scope, by).rows
        spark = self.files.sparkSession
        rows = spark.createDataFrame([(m["path"], m["belief"]) for m in members], "path string, score double")
        near = tree.nearest(rows, self.tree.where("depth = 1 and kind = 'dir'").select(F.col("path").alias("dir")))
        front = written(flow.seeds(rows.join(near, "path")))
        drawn = front.select("path", F.col("score").alias("part"), F.lit(True).alias("seed"))
        by = by or judge.Overlap([t.label for t in self.terms(subject)])
        for _ in range(depth):
            placed = front.select("path", F.row_number().over(flow.Window.orderBy("path")).alias("place"))
            new = flow.expand(placed, self.edges, drawn)
            front = written(by.score(self.files.join(new.select("path"), "path", "left_semi").withColumn("unit", F.col("path")), "flow").select("path", F.col("belief").alias("part")))
            drawn = written(drawn.unionByName(front.withColumn("seed", F.lit(False))))
            front = front.where(F.col("part") >= flow.EXPAND)
            if not front.limit(1).count():
                break
        nodes = written(flow.cut_nodes(flow.roles(drawn)))
        among = self.edges.join(nodes.select(F.col("path").alias("from")), "from", "left_semi").join(nodes.select(F.col("path").alias("to")), "to", "left_semi")
        edges = written(flow.cut_edges(flow.carries(among).select("from", "to", "carries"), nodes))
        pairs = [(r["from"], r["to"]) for r in edges.orderBy("from", "to").collect()]
        order = flow.reading_order([r.asDict() for r in nodes.collect()], pairs)
        return Result([{"path": p, "place": i + 1} for i, p in enumerate(order)], flow.chart_summary(nodes, edges, drawn.count(), among.count()).first().verdict, {"edges": pairs})

    def coverage(self, examined: DataFrame) -> DataFrame:
        """Counts of what is and isn't examined, and of what lies next to it."""
        nodes = self.files.select(F.col("path").alias("node"))
        return graph.coverage(nodes, self.edges, examined, self.resolved.where("kind = 'unresolved'"))
