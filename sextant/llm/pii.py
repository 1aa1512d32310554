"""Personal data: gradient boosting over candidates, in DataFrame functions only.

Generators of high recall propose spans that may overlap: whatever looks like an address with @ or its spelled-out form, runs of seven
or more digits, and within these what is shaped like a card or a phone number. Boosted trees read each candidate's format and context.
They learn from what the base patterns say of a candidate that stands alone, and from the same candidates with the deciding mark hidden
(an address spelled out, a phone number without its plus and country code), so that unmarked data is found too. Unmarked numbers that
no other format explains are neither right nor wrong in training. Trees grow on four fifths of the documents; each kind's threshold is
set on the others. Features are small codes, so the counts of (features, outcome) are a table of bounded size, and the trees become
one SQL expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Guards and possessive groups keep matching linear and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"  # shorter runs fail in any case
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators.
WIDE_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
WIDE_NUMBER = r"[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,}+"
CARD_SHAPE = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4})(?![0-9])"
PHONE_SHAPE = r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"

#: Codes a feature can take; their product bounds the table that trees grow on.
FEATURES = {"gen": 4, "digits": 8, "groups": 5, "sep": 6, "mark": 2, "check": 2, "context": 5, "after": 3}
#: A document in so many sets thresholds and is not learned from.
HELD = 5

SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
#: Elements that are worked on at once where a plain loop over an array would be quadratic.
RUN = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array of numbers: within runs, and then with what stands before each run."""
    none = F.array().cast("array<int>")
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(v, k * RUN + 1, F.lit(RUN)), none, add))
        return F.when(F.size(v) == 0, none).otherwise(let(runs, joined))

    def joined(runs: Column) -> Column:
        before = F.aggregate(F.transform(runs, lambda r: F.element_at(r, -1)), F.array(F.lit(0)), add)
        return let(before, lambda b: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.get(b, i)))))

    return let(values, whole)


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches as (start, end, hit, up to 24 characters before, one after), in code points, end exclusive: what a split
    leaves gives the places."""

    def placed(z: Column) -> Column:
        ends = running(F.transform(z["hits"], lambda h, i: F.length(F.get(z["gaps"], i)) + F.length(h)))
        return let(
            ends,
            lambda e: F.transform(
                z["hits"],
                lambda h, i: F.struct(
                    (F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"), h.alias("hit"), F.substring(F.get(z["gaps"], i), -24, 24).alias("before"), F.substring(F.get(z["gaps"], i + 1), 1, 1).alias("after")
                ),
            ),
        )

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Of a string of digits."""
    n = F.length(s)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(s, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return a + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _if(cond: Column, spans: Column) -> Column:
    return F.when(cond, spans).otherwise(F.array().cast(SPAN))


def in_range(h: Column) -> Column:
    """Of dotted numbers: whether each is at most 255."""
    return F.forall(F.split(h, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(p, -3, 3).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> spans of the base patterns whose checks pass."""
    numeric = text.rlike("[0-9]")
    return {
        "email": _if(text.contains("@"), found(text, EMAIL)),
        "ip": F.filter(_if(numeric & text.contains("."), found(text, IP)), lambda x: in_range(x["hit"])),
        "card": F.filter(_if(numeric, found(text, CARD)), lambda x: let(digits(x["hit"]), lambda d: F.length(d).between(13, 19) & luhn(d))),
        "phone": F.filter(_if(numeric & text.contains("+"), found(text, PHONE)), lambda x: F.length(digits(x["hit"])).between(9, 15)),
    }


def _digits_code(n: Column) -> Column:
    return F.when(n <= 2, 0).when(n <= 6, 1).when(n <= 8, 2).when(n == 9, 3).when(n <= 11, 4).when(n == 12, 5).when(n <= 19, 6).otherwise(7)


def _described(gen: int, x: Column) -> Column:
    """A candidate: start, end, kind, the code of each feature, ``right`` (what training takes it for: 1, 0 or null) and ``first``, the
    digits of its first group."""
    mail = gen == 0

    def of(z: Column) -> Column:
        hit, n, before = x["hit"], z["n"], z["before"]
        kind = F.lit("email") if mail else F.lit("card") if gen == 2 else F.lit("phone") if gen == 3 else F.when((z["groups"] == 4) & ~hit.rlike("[^0-9.]"), "ip").when(n >= 13, "card").otherwise("phone")
        if mail:
            spelled = hit.contains(" at ")
            sep = F.when(hit.rlike(r"[\[(]at"), 1).when(spelled & hit.contains(" dot "), 2).when(spelled, 3).when(hit.contains(" "), 4).otherwise(0)
            mark, check = F.lit(0), F.lit(0)
            right = F.when(sep == 3, 0).when(hit.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), 1)
        else:
            sep = F.when(hit.contains("("), 1).when(hit.contains("/"), 5).when(hit.contains("."), 2).when(hit.contains("-"), 3).when(hit.contains(" "), 4).otherwise(0)
            mark = F.substring(hit, 1, 1) == "+"
            check = F.when(kind == "card", let(digits(hit), lambda d: F.length(d).between(13, 19) & luhn(d))).when(kind == "ip", in_range(hit)).otherwise(False)
            explained = n.between(9, 15) & ~hit.rlike(r"^[0-9.]+$|^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}")
            phone = F.when(mark, (n.between(9, 15) & hit.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$")).cast("int")).when(~explained, 0)
            right = F.when(kind == "phone", phone).when(kind == "card", (check & hit.rlike(r"^[0-9]([\x20-]?[0-9])+$")).cast("int")).otherwise(check.cast("int"))
        context = F.when(before.rlike("phone|tel|call|mobil|fax"), 1).when(before.rlike("mail|contact|write"), 2).when(before.rlike("card|visa|account|pay"), 3).when(before.rlike("addr|host|server|ip"), 4).otherwise(0)
        tail = F.when(x["after"] == "", 0).when(x["after"].rlike("[A-Za-z0-9_]"), 1).otherwise(2)
        codes = {"gen": F.lit(gen), "digits": _digits_code(n), "groups": F.least(z["groups"], F.lit(5)) - 1, "sep": sep, "mark": mark, "check": check, "context": context, "after": tail}
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), *[codes[f].cast("int").alias(f) for f in FEATURES], right.cast("int").alias("right"), n.alias("n"), F.length(z["first"]).alias("first")
        )

    bare = F.regexp_replace(x["hit"], "^[^0-9]+", "")
    facts = {"n": F.length(digits(x["hit"])), "groups": F.size(F.split(bare, "[^0-9]+")), "first": F.regexp_extract(bare, "^[0-9]*", 0), "before": F.lower(x["before"])}
    return let(F.struct(*[v.alias(k) for k, v in facts.items()]), of)


def _describe(gen: int) -> Callable[[Column], Column]:
    return lambda x: _described(gen, x)


def candidates(text: Column) -> Column:
    """What the generators propose, in one array."""
    number = text.rlike("[0-9]")
    proposed = [_if(text.contains("@") | text.rlike(r"[\[( ]dot[\]) ]"), found(text, WIDE_MAIL)), _if(number, found(text, WIDE_NUMBER)), _if(number, found(text, CARD_SHAPE)), _if(number, found(text, PHONE_SHAPE))]
    return F.concat(*[F.transform(p, _describe(g)) for g, p in enumerate(proposed)])


def hidden(c: Column) -> Column:
    """The rows that a candidate gives to training: itself, and where it is right, what it would be with its mark hidden."""

    def like(**codes: Column | int) -> Column:
        return F.struct(c["kind"].alias("kind"), *[(F.lit(codes[f]) if isinstance(codes.get(f), int) else codes.get(f, c[f])).cast("int").alias(f) for f in FEATURES], c["right"].alias("right"))

    phone = like(mark=0, digits=_digits_code(c["n"] - c["first"]), groups=c["groups"] - 1)
    return (
        F.when((c["kind"] == "email") & (c["right"] == 1), F.array(like(), like(sep=1), like(sep=2), like(sep=4)))
        .when((c["kind"] == "phone") & (c["right"] == 1) & (c["groups"] >= 2), F.array(like(), phone))
        .otherwise(F.array(like()))
    )


@dataclass
class Split:
    """A node of a regression tree over feature codes: value where ``feature`` is None."""

    feature: str | None
    at: int = 0
    low: "Split | None" = None
    high: "Split | None" = None
    value: float = 0.0

    def of(self, codes: dict[str, int]) -> float:
        return self.value if self.feature is None else (self.low if codes[self.feature] <= self.at else self.high).of(codes)

    def column(self, x: Column) -> Column:
        return F.lit(self.value) if self.feature is None else F.when(x[self.feature] <= self.at, self.low.column(x)).otherwise(self.high.column(x))


@dataclass
class Boosted:
    prior: float
    trees: list[Split]
    thresholds: dict[str, float]

    def of(self, codes: dict[str, int]) -> float:
        return 1 / (1 + math.exp(-self.prior - sum(t.of(codes) for t in self.trees)))

    def column(self, x: Column) -> Column:
        total = F.lit(self.prior)
        for t in self.trees:
            total = total + t.column(x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


Row = tuple[dict[str, int], str, float, float]  # codes, kind, count, how many of these are right


def grow(rows: list[Row], grad: list[float], hess: list[float], depth: int, rate: float) -> Split:
    g, h = sum(grad), sum(hess)
    best = (1e-6, None, 0)
    if depth:
        for f, codes in FEATURES.items():
            for at in range(codes - 1):
                gl = sum(x for x, r in zip(grad, rows, strict=True) if r[0][f] <= at)
                hl = sum(x for x, r in zip(hess, rows, strict=True) if r[0][f] <= at)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                best = max(best, (gain, f, at), key=lambda b: b[0])
    if best[1] is None:
        return Split(None, value=-rate * g / (h + 1))
    _, f, at = best
    parts = []
    for low in (True, False):
        keep = [i for i, r in enumerate(rows) if (r[0][f] <= at) == low]
        parts.append(grow([rows[i] for i in keep], [grad[i] for i in keep], [hess[i] for i in keep], depth - 1, rate))
    return Split(f, at, *parts)


def boost(rows: list[Row], held: list[Row] | None = None, trees: int = 24, depth: int = 3, rate: float = 0.5, precision: float = 0.95) -> Boosted:
    """Newton boosting of the logistic loss on counted rows. A kind's threshold is the least score from which on ``precision`` of the
    rows of ``held`` (without these, of the learned rows) are right; none of a kind is selected where no score gives that."""
    n, p = sum(r[2] for r in rows), sum(r[3] for r in rows)
    model = Boosted(math.log((p + 1) / (n - p + 1)), [], {})
    score = [model.prior] * len(rows)
    for _ in range(trees if n else 0):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        grad = [q * r[2] - r[3] for q, r in zip(prob, rows, strict=True)]
        hess = [q * (1 - q) * r[2] for q, r in zip(prob, rows, strict=True)]
        tree = grow(rows, grad, hess, depth, rate)
        model.trees.append(tree)
        score = [s + tree.of(r[0]) for s, r in zip(score, rows, strict=True)]
    for kind in KINDS:
        judged = [r for r in held or [] if r[1] == kind] or [r for r in rows if r[1] == kind]
        model.thresholds[kind] = threshold([(model.of(r[0]), r[2], r[3]) for r in judged], precision)
    return model


def threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """Of (score, count, right): the least score at and above which the share of right ones is ``precision``; 2 where none is. It is
    set halfway to the next lower score, but not below one half."""
    own = sorted(scored, reverse=True)
    count = right = 0.0
    best = 2.0
    for i, (s, c, k) in enumerate(own):
        count, right = count + c, right + k
        if (i + 1 == len(own) or own[i + 1][0] < s) and right >= precision * count and right > 0:
            best = max((s + (own[i + 1][0] if i + 1 < len(own) else 0.0)) / 2, min(s, 0.5))
    return best


def overlaps(x: Column, o: Column) -> Column:
    return (o["start"] < x["end"]) & (x["start"] < o["end"])


def apart(spans: Column, others: Column, beats: Callable[[Column, Column], Column]) -> Column:
    """The spans (sorted by start) that none of ``others`` overlaps and ``beats``. Each run of spans meets only the others in its reach."""

    def of(z: Column) -> Column:
        s, o = z["s"], z["o"]

        def kept(k: Column) -> Column:
            run = F.slice(s, k * RUN + 1, F.lit(RUN))
            return let(run, lambda r: let(F.struct(F.get(r, F.lit(0))["start"].alias("start"), F.array_max(F.transform(r, lambda x: x["end"])).alias("end")), lambda reach: let(F.filter(o, lambda y: overlaps(reach, y)), lambda near: F.filter(r, lambda x: ~F.exists(near, lambda y: overlaps(x, y) & beats(x, y))))))

        return F.when(F.size(s) == 0, s).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), kept)))

    return let(F.struct(spans.alias("s"), others.alias("o")), of)


def train(docs: DataFrame) -> Boosted:
    """Count (features, kind, right) over every candidate of every text; boost on four fifths of the documents, set thresholds on the rest."""
    t = F.col("text")
    part = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD)) == 0).alias("held")
    rows = texts(docs).where(t.rlike(r"[0-9@]|[\[( ]dot[\]) ]")).select(part, F.explode(candidates(t)).alias("c")).where("c.right is not null")
    each = rows.select("held", F.explode(hidden(F.col("c"))).alias("r")).select("held", "r.*")
    counts = each.groupBy("held", "kind", *FEATURES).agg(F.count("*").alias("count_of"), F.sum("right").alias("right_of")).collect()
    assert len(counts) <= 2 * len(KINDS) * math.prod(FEATURES.values())
    counts.sort(key=lambda r: tuple(r[:-2]))
    of = lambda held: [({f: r[f] for f in FEATURES}, r.kind, float(r.count_of), float(r.right_of)) for r in counts if r.held == held]
    return boost(of(False) or of(True), of(True))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


PLAIN = "array<struct<kind:string,start:int,end:int>>"


def _plain(spans: Column, kind: Column | None = None) -> Column:
    return F.transform(spans, lambda x: F.struct((x["kind"] if kind is None else kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans, n_added.

    Null texts are empty; an empty table gives no rows; repeated rows each give one; very long texts are searched whole; other columns
    are ignored. Base spans always stay; an added span overlaps none of them, and of added ones that overlap each other the first and
    then the longest stays.
    """
    model = model or train(docs)
    t = F.col("text")
    base = base_spans(t)
    rows = texts(docs).select("doc_id", "text", *[_plain(c, F.lit(k)).alias(f"b_{k}") for k, c in base.items()])
    rows = rows.select("doc_id", "text", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*[F.col(f"b_{k}") for k in KINDS]).alias("base"))
    limit = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(float(v))) for k, v in model.thresholds.items()])
    none = F.array().cast(PLAIN)
    if any(v <= 1 for v in model.thresholds.values()):
        good = F.filter(F.when(t.rlike(r"[0-9@]|[\[( ]dot[\]) ]"), candidates(t)), lambda x: model.column(x) >= limit(x))
        by_start = lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.nullif(F.signum(b["end"] - a["end"]), F.lit(0.0)), F.lit(0.0)).cast("int")
        rows = rows.withColumn("good", F.coalesce(F.array_sort(F.array_distinct(_plain(good)), by_start), none))
        rows = rows.withColumn("good", apart(F.col("good"), F.col("base"), lambda x, y: F.lit(True)))
        first = lambda x, y: (y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["end"] > x["end"])) | ((y["start"] == x["start"]) & (y["end"] == x["end"]) & (y["kind"] < x["kind"]))
        rows = rows.withColumn("added", F.when(F.size("good") < 2, F.col("good")).otherwise(apart(F.col("good"), F.col("good"), first)))
    else:
        rows = rows.withColumn("added", none)
    everything = F.concat(F.col("base"), F.col("added"))
    by_kind = F.concat(*[F.array_sort(_of_kind(everything, k)) for k in KINDS])
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(by_kind).alias("spans"), F.size("added").cast("long").alias("n_added"))
