"""Every registered query of the reference's operators and its DuckDB SQL."""

from __future__ import annotations

from sextant.plans import evaluation, judging, lexical, references, structure, texts

_MODULES = (lexical, structure, evaluation, texts, judging, references)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
