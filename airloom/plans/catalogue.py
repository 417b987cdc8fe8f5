"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from . import roundtrip, serving, streams, telemetry, text, tickets

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (telemetry, tickets, text, serving, streams, roundtrip):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL

flagship = telemetry.symptoms
