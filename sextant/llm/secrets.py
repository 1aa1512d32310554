"""Secret scans: a linear-chain conditional random field over all tokens of a text, decoded by Viterbi.

Base patterns find assignments, access keys and hexadecimal runs. The field tags every token as secret begin, inside or outside by
shape, neighbouring words and features of the text. It learns from what the base patterns find in a bounded sample, and from the same
texts with the deciding mark hidden (another keyword or none, another prefix, fewer digits), so that it finds what they miss; what it
asks beyond a plain maximum is set on texts that it has not learned from.

Most tokens are plain: short, or letters only, after no mark that assigns. All plain tokens have the same one feature, so a run of n of
them is one step of the chain, the n-th power of their step in (max, +). Powers soon differ by a constant only. A text is decoded over
its other tokens with such steps between, which is the same path as over all tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import small_batches, texts

KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run would be dropped
HEX = re.compile(r"[0-9a-f]{32,}")
#: A token of the chain: key characters; a trailing = or two belong to it unless a value follows.
TOKEN = re.compile(r"""[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]*(?:={1,2}(?![A-Za-z0-9+/"'=]))?""")
#: A token that is not plain by itself: 8 characters or more with a digit, or 16 or more.
ODD = re.compile(r"""(?<![A-Za-z0-9+/_.-])(?:(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{7,}|[A-Za-z+/_-][A-Za-z+/_.-]{15,})(?:={1,2}(?![A-Za-z0-9+/"'=]))?""")
#: What makes the next token one that is looked at: a mark that assigns, or a keyword.
CUE = re.compile(r"""[=:]["']?\x20{0,2}["']?$""")
LINKS = ("is", "was", "the", "my")
KEYWORD = re.compile(r"(?i:pass|pwd|secret|token|key|cred|auth|bearer|private)", re.ASCII)
OUT, BEGIN, IN = 0, 1, 2

Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def base_spans(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


@dataclass
class Chain:
    """The tokens of a text that are not plain, and how many plain ones stand before each and after the last."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    rest: int = 0
    plain: list[bool] = field(default_factory=list)  # of every token


def chain(text: str, whole: bool = False) -> Chain:
    """The tokens of a text in order; ``whole``: plain ones too, as tokens of their own."""
    out = Chain()
    named = KEYWORD.search(text) is not None
    if not whole and not named and "=" not in text and ":" not in text and ODD.search(text) is None:
        out.rest = len(TOKEN.findall(text))
        return out
    count, word, last = 0, "", 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        gap = text[last:a]
        looked = b - a >= 8 and ODD.fullmatch(text, a, b) is not None
        if not looked and b - a >= 4:
            looked = gap != " " and CUE.search(gap) is not None or named and len(gap) <= 4 and KEYWORD.search(word) is not None
        out.plain.append(not looked)
        if looked or whole:
            out.spans.append((a, b))
            out.before.append(count)
            count = 0
        else:
            count += 1
        if b - a > 3 or text[a:b].lower() not in LINKS:
            word = text[a:b]
        last = b
    out.rest = count
    return out


#: Feature of every plain token; it is the whole of what a plain token shows.
PLAIN = ["plain"]
WIDTH = 16


def features(text: str, start: int, end: int, about: tuple[bool, bool]) -> list[str]:
    """Names of a token's features; no check of a base pattern (its keyword's exact form, 32 characters, the prefix) is one of them."""
    t = text[start:end]
    bare = t.strip("=.")
    n, kinds = len(bare), len(set(bare))
    shape = "digits" if re.fullmatch(r"[0-9.+/_=-]+", t) else "hex" if re.fullmatch(r"[0-9a-f]+", bare) else "upper" if re.fullmatch(r"[A-Z0-9]+", bare) else "letters" if bare.isalpha() else "lower" if bare == bare.lower() else "mixed"
    inner = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", bare))
    before = text[max(0, start - 64) : start]
    words = re.findall(r"[A-Za-z_]+", before)
    after = re.match(r"[^A-Za-z]{0,4}([A-Za-z]+)", text[end : end + 40])
    mark = before.rstrip(" \"'")[-1:]
    keyword = bool(words and (KEYWORD.search(words[-1]) or len(words) > 1 and words[-1].lower() in ("is", "was") and KEYWORD.search(words[-2])))
    return [
        "bias",
        f"shape {shape}",
        f"length {min(n // 4, 9)}",
        f"shape {shape} length {min(n // 8, 5)}",
        f"changes {min(len(inner) // 3, 5)}",
        f"variety {min(kinds // 4, 6)}",
        f"entropy {int(2 * entropy(bare))}",
        f"shape {shape} entropy {int(2 * entropy(bare))}",
        f"mark {mark if mark in ('=', ':', '@', '(', '.', '/') else 'other'} keyword {keyword}",
        f"quote {before[-1:] in (chr(34), chr(39))}",
        f"keyword {keyword} shape {shape}",
        f"dots {min(bare.count('.'), 3)} slashes {min(bare.count('/'), 3)} dashes {min(bare.count('-'), 4)}",
        f"previous {words[-1].lower()[:16] if words else ''}",
        f"next {after[1].lower()[:16] if after else ''}",
        f"text assigns {about[0]}",
        f"text names keys {about[1]}",
    ]


def entropy(s: str) -> float:
    if not s:
        return 0.0
    return -sum(k / len(s) * math.log2(k / len(s)) for k in (s.count(c) for c in set(s)))


def about(text: str) -> tuple[bool, bool]:
    return "=" in text, bool(KEYWORD.search(text))


@dataclass
class Field:
    names: dict[str, int]
    emit: np.ndarray  # (features, 3)
    step: np.ndarray  # (3, 3), from row to column; from OUT at the start of a text
    margin: float = 0.0  # what a secret's begin must win by
    powers: list[np.ndarray] = field(default_factory=list)

    def emissions(self, tokens: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(tokens), 3))
        for i, fs in enumerate(tokens):
            for f in fs:
                if (k := self.names.get(f)) is not None:
                    out[i] += self.emit[k]
        out[:, BEGIN] -= self.margin
        return out

    def power(self, n: int) -> np.ndarray:
        """Best score from the tag before n plain tokens to the tag of the last of them, less n times the step from outside to outside."""
        if not self.powers:
            one = self.step + self.emissions([PLAIN])[0]
            self.powers += [np.where(np.eye(3, dtype=bool), 0.0, -1e9), one - one[OUT, OUT]]
        while len(self.powers) <= n:
            new = (self.powers[-1][:, :, None] + self.powers[1][None]).max(1)
            if np.abs(new - self.powers[-1]).max() < 1e-9:
                break
            self.powers.append(new)
        return self.powers[min(n, len(self.powers) - 1)]

    def path(self, emissions: np.ndarray, before: list[int], rest: int) -> tuple[list[int], bool]:
        """Best tags of tokens with so many plain ones before each, and whether all plain ones are outside on that path."""
        best, back = np.array([0.0, -1e9, -1e9]), []
        for e, n in zip(emissions, before, strict=True):
            ways = best[:, None] + (self.power(n)[:, :, None] + self.step[None]).max(1)
            back.append(ways.argmax(0))
            best = ways.max(0) + e
        ends = best + self.power(rest).max(1)
        tags = [int(ends.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        tags.reverse()
        calm = True
        for a, b, n in zip(tags, [*tags[1:], None], [*before, rest], strict=True):
            if n:
                after = self.step[:, b] if b is not None else np.zeros(3)
                calm &= (self.power(n)[a] + after).max() <= self.power(1)[a, OUT] + after[OUT] + 1e-9
        return tags[1:], calm

    def decode(self, text: str) -> list[tuple[int, int]]:
        """Spans that the best path over all tokens tags as secrets."""
        found = chain(text)
        facts = about(text)
        emissions = self.emissions([features(text, a, b, facts) for a, b in found.spans])
        tags, calm = self.path(emissions, found.before, found.rest)
        if not calm:
            found = chain(text, whole=True)
            emissions = self.emissions([PLAIN if p else features(text, a, b, facts) for (a, b), p in zip(found.spans, found.plain, strict=True)])
            tags, _ = self.path(emissions, found.before, 0)
        out: list[tuple[int, int]] = []
        for (a, b), tag in zip(found.spans, tags, strict=True):
            if tag == BEGIN:
                out.append((a, b))
            elif tag == IN:
                out[-1] = (out[-1][0], b)
        return out


def _allowed() -> np.ndarray:
    """Inside follows only begin or inside."""
    step = np.zeros((3, 3))
    step[OUT, IN] = -1e4
    return step


Sequence = tuple[list[list[str]], list[int]]  # features and tag of each token


def fit(sequences: list[Sequence], rounds: int = 100, penalty: float = 0.5) -> Field:
    """Conditional log likelihood by Adagrad; sequences of one length go through forward and backward passes together."""
    names: dict[str, int] = {"": 0}  # what fills up a plain token's features
    by_length = defaultdict(list)
    for tokens, tags in sequences:
        by_length[len(tokens)].append(([[names.setdefault(f, len(names)) for f in fs] + [0] * (WIDTH - len(fs)) for fs in tokens], tags))
    model = Field(names, np.zeros((len(names), 3)), _allowed())
    packed = [(np.array([t for t, _ in own], np.int32), np.array([g for _, g in own])) for own in by_length.values()]
    total = max(1, sum(len(t) for t, _ in sequences))
    seen_e, seen_s = np.full_like(model.emit, 1e-4), np.full((3, 3), 1e-4)
    for _ in range(rounds if sequences else 0):
        grad_e, grad_s = -penalty * model.emit, np.zeros((3, 3))
        for idx, tags in packed:  # idx: sequences x length x features
            s, n, _w = idx.shape
            emissions = model.emit[idx].sum(2)
            forward, backward = np.zeros((s, n, 3)), np.zeros((s, n, 3))
            forward[:, 0] = model.step[OUT] + emissions[:, 0]
            for i in range(1, n):
                forward[:, i] = logsum(forward[:, i - 1, :, None] + model.step, 1) + emissions[:, i]
            for i in range(n - 2, -1, -1):
                backward[:, i] = logsum(model.step + (emissions[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            norm = logsum(forward[:, -1], 1)
            error = -np.exp(forward + backward - norm[:, None, None])
            np.put_along_axis(error, tags[:, :, None], np.take_along_axis(error, tags[:, :, None], 2) + 1, 2)
            flat, each = idx.reshape(-1), np.repeat(error.reshape(-1, 3), idx.shape[2], 0)
            grad_e += np.stack([np.bincount(flat, each[:, k], len(names)) for k in range(3)], 1)
            grad_s[OUT] += error[:, 0].sum(0)
            for i in range(1, n):
                pair = forward[:, i - 1, :, None] + model.step + (emissions[:, i] + backward[:, i])[:, None, :] - norm[:, None, None]
                grad_s -= np.exp(pair).sum(0)
                np.add.at(grad_s, (tags[:, i - 1], tags[:, i]), 1)
        grad_s[OUT, IN], grad_e[0] = 0, 0
        grad_e, grad_s = grad_e / total, grad_s / total
        seen_e += grad_e**2
        seen_s += grad_s**2
        model.emit += 0.3 * grad_e / np.sqrt(seen_e)
        model.step += 0.3 * grad_s / np.sqrt(seen_s)
    if not sequences:
        model.step[OUT, BEGIN] = -1.0
    return model


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


#: Plain tokens that a training sequence keeps around the others; where more stand between two, it is cut.
AROUND = 3
#: What stands for a base pattern's mark in training texts that hide it. Fixed values.
OTHER_WORDS = ("pwd", "credential", "client_key", "auth", "bearer", "private_key", "access_key", "passphrase", "signing_key")
OTHER_MARKS = (" = ", "=", ": ", ": '", ' = "', " ", " is ")
OTHER_PREFIXES = ("ASIA", "AGPA", "ABIA", "ghp_", "sk_live_", "xoxb-")
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "abcdefghijklmnopqrstuvwxyz")


def values(text: str) -> list[tuple[int, int]]:
    """Where the base patterns see the secrets themselves: an assignment's value, a key, a run of figures; overlaps count once."""
    own = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if "=" in text or ":" in text else []
    own += [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]
    return sorted(own)


def tagged(text: str, secret: list[tuple[int, int]] | None = None) -> list[Sequence]:
    """A text's sequences around tokens that aren't plain, with tags from ``secret`` (else the base patterns' values)."""
    secret, facts = values(text) if secret is None else secret, about(text)
    found = chain(text)
    out: list[Sequence] = []
    open_span = None
    for (a, b), n in zip(found.spans, found.before, strict=True):
        own = next((s for s in secret if s[0] < b and a < s[1]), None)
        tag = OUT if own is None else IN if own == open_span and n == 0 else BEGIN
        open_span = own
        if not out or n > AROUND or len(out[-1][0]) > 60:
            if out:
                out[-1][0].extend([PLAIN] * AROUND)
                out[-1][1].extend([OUT] * AROUND)
            out.append(([PLAIN] * min(n, AROUND), [OUT] * min(n, AROUND)))
        else:
            out[-1][0].extend([PLAIN] * n)
            out[-1][1].extend([OUT] * n)
        out[-1][0].append(features(text, a, b, facts))
        out[-1][1].append(tag)
    if out and found.rest:
        out[-1][0].extend([PLAIN] * min(found.rest, AROUND))
        out[-1][1].extend([OUT] * min(found.rest, AROUND))
    return out


def hidden(text: str, rng: random.Random) -> list[Sequence]:
    """Sequences of what stands around each base value with its mark hidden, and of the same marks before a word of the text."""
    out = []
    words = re.findall(r"[A-Za-z]{4,12}", text[:4000]) or ["nothing"]
    for a, b in values(text)[:8]:
        first = re.search(r"(?:[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?)?$", text[max(0, a - 40) : a])
        left, right = text[max(0, a - 80) : a - len(first[0])], text[b : b + 80]
        drawn = "".join(rng.choice(rng.choice(ALPHABETS[:4])) for _ in range(1)) + "".join(rng.choices(rng.choice(ALPHABETS), k=rng.choice((9, 12, 16, 20, 24, 31, 36, 40))))
        for value in (text[a:b][: rng.randrange(16, 31)], drawn):
            mark = rng.choice(OTHER_WORDS) + rng.choice(OTHER_MARKS)
            out += tagged(f"{left} {mark}{value}{right}", [(len(left) + 1 + len(mark), len(left) + 1 + len(mark) + len(value))])
        prefix = rng.choice(OTHER_PREFIXES)
        key = prefix + "".join(rng.choices(ALPHABETS[1] if prefix[0] == "A" else ALPHABETS[2], k=16 if prefix[0] == "A" else 30))
        out += tagged(f"{left} {key} {right}", [(len(left) + 1, len(left) + 1 + len(key))])
        for _ in range(3):
            plain = rng.choice((rng.choice(words), rng.choice(words), rng.choice(words).lower(), str(rng.randrange(10**5)), f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}", f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(99)}", f"{rng.choice(words)}/{rng.choice(words)}.txt"))
            out += tagged(f"{left} {rng.choice((*OTHER_WORDS, 'password', 'secret', 'token'))}{rng.choice(OTHER_MARKS)}{plain} {right}", [])
    return out


def calibrate(model: Field, held: list[Sequence], precision: float = 0.97) -> None:
    """The least margin at which ``precision`` of the begins that are found in held-out sequences are right."""
    coded = [(model.emissions(tokens), tags) for tokens, tags in held if any(t != PLAIN for t in tokens)]
    for margin in (0.0, 0.5, 1.0, 2.0, 3.0, 5.0):
        found = right = 0
        for emissions, tags in coded:
            own, _ = model.path(emissions - np.array([0.0, margin, 0.0]), [0] * len(tags), 0)
            found += own.count(BEGIN)
            right += sum(x == y == BEGIN for x, y in zip(own, tags, strict=True))
        model.margin = margin
        if right >= precision * found:
            break
    model.powers.clear()


def learn(sample: list[str]) -> Field:
    """Fit on four fifths of the texts with their hidden forms, calibrate on the others."""
    learned: list[Sequence] = []
    held: list[Sequence] = []
    for k, text in enumerate(sample):
        own = tagged(text) + hidden(text, random.Random(k))
        (held if k % 5 == 4 else learned).extend(own)
    model = fit(learned)
    if held:
        calibrate(model, held)
    return model


def train(docs: DataFrame, bound: int = 3000, longest: int = 32_768) -> Field:
    """Learn from at most ``bound`` texts of at most ``longest`` bytes that hold two digits in a row, those of least
    xxhash64(doc_id, text).

    The hashes alone are ordered first, so that no task sends more texts than are learned from.
    """
    rows = texts(docs).where(F.col("text").rlike("[0-9]{2}") & (F.octet_length("text") <= longest)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = rows.select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= last).orderBy("h", "text").limit(bound).collect() if last is not None else []
    return learn([r.text for r in rows])


def scan(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans that the field adds: they overlap no base span."""
    base = base_spans(text)
    added = [(3, a, b) for a, b in model.decode(text)]
    if base and added:
        starts = np.array([x[1] for x in base])
        ends = np.maximum.accumulate(np.array([x[2] for x in base]))
        last = np.searchsorted(starts, [s[2] for s in added]) - 1  # of the base spans that begin before an added one's end
        added = [s for s, k in zip(added, last.tolist(), strict=True) if k < 0 or ends[k] <= s[1]]
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def _scanner(field) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = field.value
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, added = scan(t, own)
                counts = [sum(s[0] == k for s in base) for k in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def find(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (of the base patterns), base_sha256, spans, n_added of every document.

    Null texts are empty; an empty table gives no rows; repeated rows each give one; very long texts are one chain each, whole; other
    columns are ignored. Offsets are code points, ends exclusive.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model or train(docs))  # features of a bounded sample
    return texts(docs).mapInArrow(_scanner(held), COLUMNS)
