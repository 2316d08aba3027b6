"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

from textmend.plans import alignment, baselines, blanks, corpus, drawn, fitting, mixing, preparation, repair, scoring, search

QUERIES = {**corpus.QUERIES, **repair.QUERIES, **search.QUERIES, **preparation.QUERIES, **scoring.QUERIES, **alignment.QUERIES, **baselines.QUERIES, **drawn.QUERIES, **fitting.QUERIES, **blanks.QUERIES, **mixing.QUERIES}
ORACLE_SQL = {**corpus.ORACLE_SQL, **repair.ORACLE_SQL, **search.ORACLE_SQL, **preparation.ORACLE_SQL, **scoring.ORACLE_SQL, **baselines.ORACLE_SQL, **drawn.ORACLE_SQL, **fitting.ORACLE_SQL, **blanks.ORACLE_SQL, **mixing.ORACLE_SQL}
