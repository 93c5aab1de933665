"""All registered queries and their SQL."""

from lectern.plans import browse, changes, creatures, evidence, extraction, projection, reader, relational, retrieval, scalars, snapshots, stored, streams
from lectern.plans.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "browse", "changes", "creatures", "evidence", "extraction", "projection", "reader", "relational", "retrieval", "scalars", "snapshots", "stored", "streams"]
FLAGSHIP = "r_13_hybrid_search"
