"""String, token and array functions as Column builders, and the same as DuckDB expressions where a query needs an oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_BODY, MAX_LINE, MAX_TF = 262_144, 400, 65_535
LIST_CAP = 2_000
#: What is cut from the ends of a line: the space separators, as DuckDB's trim has them.
BLANKS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CHARS_PER_TOKEN, OPTION_TOKENS, LEAST_OPTION, MOST_OPTION = 3.68, 12_000, 45, 160

#: Where an identifier falls apart: before a capital after a small letter or digit, and before the last capital of an acronym unless
#: only a plural s follows it.
_CASE_EDGE = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z](?:[a-rt-z]|s[a-z]))"


def spaced(text: Column) -> Column:
    """Lower-case parts with blanks between. Once only ASCII letters, digits and blanks are left, all is lower-cased at once."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, _CASE_EDGE, " "), "[^A-Za-z0-9]+", " "))


def _parts(text: Column) -> Column:
    """Lower-case parts, with empty ones."""
    return F.split(spaced(text), " ")


def token_count(spaced_text: Column) -> Column:
    """How many index tokens ``spaced`` text has: the length of ``tokenize`` without an array."""
    return F.regexp_count(spaced_text, F.lit(r"(?<![a-z0-9])(?=[a-z0-9]{2,32}(?![a-z0-9]))[0-9]*+[a-z][a-z0-9]*+"))


def word_count(spaced_text: Column, forms: list[str]) -> Column:
    """How many parts of ``spaced`` text are one of ``forms``."""
    return F.regexp_count(spaced_text, F.lit(r"\b(?:" + "|".join(map(re.escape, sorted(forms))) + r")\b")) if forms else F.lit(0)


def split_ident(text: Column) -> Column:
    """Lower-case parts of identifiers; whatever is not an ASCII letter or digit separates (T1). Split first, then lower-case."""
    return F.filter(_parts(text), lambda x: x != "")


def stem(word: Column) -> Column:
    """Plural endings only."""
    n = F.length(word)
    return (
        F.when((n < 4) | ~word.endswith("s"), word)
        .when((n > 4) & word.rlike("[^ea]ies$"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("(x|z|ch|sh|ss)es$"), F.substring(word, F.lit(1), n - 2))
        .when(word.rlike("[sui]s$"), word)
        .otherwise(F.substring(word, F.lit(1), n - 1))
    )


def tokenize(text: Column) -> Column:
    """Index tokens: parts of 2 to 32 characters with a letter, stemmed."""
    return F.transform(F.filter(_parts(text), lambda x: F.length(x).between(2, 32) & x.rlike("[a-z]")), stem)


def body_text(body: Column) -> Column:
    """The part of a body that is indexed: its first MAX_BODY characters without lines over MAX_LINE (T4)."""
    return F.array_join(F.filter(F.split(F.substring(body, 1, MAX_BODY), "\n"), lambda x: F.length(x) <= MAX_LINE), "\n")


def body_tokens(body: Column) -> Column:
    return tokenize(body_text(body))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def path_tokens(path: Column) -> Column:
    """A path's tokens, and its last name's once more."""
    return F.concat(tokenize(path), tokenize(base_name(path)))


def ext_of(name: Column) -> Column:
    """Lower-case extension with its dot; none for a name that begins with its only dot."""
    low = F.lower(name)
    return F.when(low.rlike("^dockerfile"), F.lit("dockerfile")).otherwise(F.regexp_extract(low, r"^.+(\.[^.]+)$", 1))


def line_count(text: Column) -> Column:
    """Lines; an end of line at the end of the text begins none."""
    return F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0)


def head_lines(text: Column, n: int, width: int = 140) -> Column:
    """The first n lines that aren't blank, cut to a width with an ellipsis."""
    full = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(BLANKS))), lambda x: F.ltrim(x, F.lit(BLANKS)) != ""), 1, n)
    return F.transform(full, lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty without one."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != ""), F.lit(1)), F.lit(""))


def name_words(name: Column, generic: list[str]) -> Column:
    """Words of a file or folder name for themes: no extension or role suffix, three letters at least, none of ``generic``."""
    bare = F.regexp_replace(name, r"(\.(test|spec|stories|d))?\.[^.]+$", "")
    return F.filter(split_ident(bare), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$") & ~x.isin(*generic))


def ident_words(name: Column) -> Column:
    """Words of an identifier for rarity: more than one character and not a number."""
    return F.filter(split_ident(name), lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$"))


def clip(text: Column, cap: int) -> Column:
    """Cut at a word's end with an ellipsis, unless that loses over 24 characters."""
    cut = F.substring(text, 1, cap - 1)
    word = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(text) <= cap, text).when(F.length(cut) - F.length(word) <= 24, F.concat(word, F.lit("…"))).otherwise(F.concat(cut, F.lit("…")))


def flatten_prose(text: Column) -> Column:
    """One line of prose; empty where no two letters stand together."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat.rlike(r"\p{L}{2}"), flat).otherwise("")


def uniq(items: Column) -> Column:
    return F.slice(F.array_distinct(items), 1, LIST_CAP)


def first_sentence(text: Column, cap: int = 150) -> Column:
    """Up to the first . ? or ! that ends a word, at most ``cap`` characters."""
    found = F.regexp_extract(text, r"(?s)^(.+?[.!?])(\s|$)", 1)
    return F.substring(F.when(found == "", text).otherwise(found), 1, cap)


def safe_path(path: Column) -> Column:
    """Relative, without backslashes, NULs and . or .. segments."""
    return ~(path.rlike(r"^/|\\|\x00|(^|/)\.{1,2}(/|$)") | (path == ""))


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Every folder above a path, outermost first, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def under(path: Column, scope: str) -> Column:
    """In a scope: the same path or below it."""
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def estimate_tokens(n_chars: Column) -> Column:
    return F.ceil(n_chars / CHARS_PER_TOKEN)


def option_budget(options: Column) -> Column:
    """Tokens for one of so many options."""
    return F.greatest(F.lit(LEAST_OPTION), F.least(F.lit(MOST_OPTION), F.floor(F.lit(OPTION_TOKENS) / F.greatest(options, F.lit(1)))))


def plain_words(text: Column) -> Column:
    """Words of the plain baselines: letter first, three characters at least."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))


def uses_name(line: Column, name: str) -> Column:
    """The name stands in the line as an identifier of its own."""
    return line.rlike(r"(?<![A-Za-z0-9_$])" + re.escape(name) + r"(?![A-Za-z0-9_$])")


def normalized_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def markdown_text(text: Column) -> Column:
    """Without images, link targets and marks of emphasis or code."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(out, r"[*_`~]+|<[^>]+>", ""))


#: What asks and what is asked about it, at the two ends of a question.
ASKING = r"(?i)^\s*(please\s+)?((can|could) you\s+)?(how (does|do|is|are|did|can)|what (is|are|does)|where (is|are|does|do)|explain|trace|describe|show me|walk me through|find)\s+((the|a)\s+)?"
ASKED = r"(?i)(\s+(works?|happens?|functions?|done|handled|implemented))?\s*\??\s*$"


def topic(question: Column) -> Column:
    """The subject of a question, without what asks for it; the question itself where nothing else is in it."""
    bare = F.regexp_replace(F.regexp_replace(question, ASKING, ""), ASKED, "")
    return F.when(bare == "", question).otherwise(bare)


class Duck:
    """The same expressions for DuckDB, which has no lookaround: two replacements with groups in place of one."""

    @staticmethod
    def split_ident(x: str) -> str:
        cut = rf"regexp_replace(regexp_replace({x}, '([A-Z])([A-Z](?:[a-rt-z]|s[a-z]))', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
        return f"list_transform(list_filter(regexp_split_to_array({cut}, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"

    @staticmethod
    def stem(x: str) -> str:
        return f"""CASE WHEN length({x}) < 4 OR right({x}, 1) <> 's' THEN {x}
            WHEN length({x}) > 4 AND regexp_matches({x}, '[^ea]ies$') THEN {x}[:-4] || 'y'
            WHEN length({x}) > 4 AND regexp_matches({x}, '(x|z|ch|sh|ss)es$') THEN {x}[:-3]
            WHEN regexp_matches({x}, '[sui]s$') THEN {x} ELSE {x}[:-2] END"""

    @classmethod
    def tokenize(cls, x: str) -> str:
        return f"list_transform(list_filter({cls.split_ident(x)}, lambda x: length(x) BETWEEN 2 AND 32 AND regexp_matches(x, '[a-z]')), lambda x: {cls.stem('x')})"

    @staticmethod
    def body_text(x: str) -> str:
        return f"array_to_string(list_filter(string_split(substr({x}, 1, {MAX_BODY}), chr(10)), lambda x: length(x) <= {MAX_LINE}), chr(10))"

    @staticmethod
    def first_line(x: str) -> str:
        return f"coalesce(list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '')"

    @classmethod
    def units(cls) -> str:
        return f"""units AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, {cls.first_line('text')} AS sig, text AS body FROM documents)"""

    @classmethod
    def tokens(cls) -> str:
        return f"""{cls.units()},
        toks AS (SELECT path, list_concat({cls.tokenize('path')}, {cls.tokenize("regexp_extract(path, '([^/]*)$', 1)")}) AS tp, {cls.tokenize('sig')} AS ts, {cls.tokenize(cls.body_text('body'))} AS tb FROM units)"""
