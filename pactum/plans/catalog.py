"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pactum.plans import contracts, texts, tiers

FLAGSHIP = "contract_risk"
QUERIES: dict = {**contracts.QUERIES, **texts.QUERIES, **tiers.QUERIES}
ORACLE_SQL: dict[str, str] = {**contracts.ORACLE_SQL, **texts.ORACLE_SQL, **tiers.ORACLE_SQL}
