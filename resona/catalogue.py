"""All registered queries outside the optional subpackages, and their SQL twins."""

from __future__ import annotations

from resona.plans import more, records, signals, text

QUERIES = signals.QUERIES | text.QUERIES | records.QUERIES | more.QUERIES
SQL = signals.SQL | text.SQL | records.SQL | more.SQL
