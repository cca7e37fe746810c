"""All registered queries of the library itself."""

from __future__ import annotations

from .plans import accuracy, editing, geometry, headers, joins, ledger, lyrics, measures, more, repair, review, roles, scores, sequences, structure, syllables, texts  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
