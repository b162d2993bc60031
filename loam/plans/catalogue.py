"""The registered queries over the test tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from loam.plans import documents, indexes, retrieval, running

hybrid_flagship = retrieval.hybrid_flagship
QUERIES = {**documents.C.queries, **retrieval.C.queries, **running.C.queries, **indexes.C.queries}
ORACLES = {**documents.C.oracles, **retrieval.C.oracles, **running.C.oracles, **indexes.C.oracles}
