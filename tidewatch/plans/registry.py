"""All queries by name, and the SQL each is held against."""

from __future__ import annotations

from . import posts_sql, reports_sql, text_sql, topics_sql, trends_sql

QUERIES: dict = {}
ORACLES: dict = {}
for part in (trends_sql, posts_sql, text_sql, topics_sql, reports_sql):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
