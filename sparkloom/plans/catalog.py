"""Every query of the engine by name."""

from __future__ import annotations

from sparkloom.plans import activity, corpus, dialogue, evaluation, learning, relational, reports, retrieval, runs, streams, texts  # noqa: F401
from sparkloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "lexical_topk"
