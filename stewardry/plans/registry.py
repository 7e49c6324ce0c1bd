"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from stewardry.plans import queries_basic, queries_subjects

QUERIES = {**queries_basic.QUERIES, **queries_subjects.QUERIES}
CHECKS = {**queries_basic.CHECKS, **queries_subjects.CHECKS}
