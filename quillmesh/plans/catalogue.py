"""The queries of the engine's own operators over the driver's tables, each with its SQL."""

from quillmesh.plans import graph_queries, member_queries, model_queries, planning_queries, relational_queries, text_queries  # noqa: F401
from quillmesh.plans.registry import ORACLES, QUERIES  # noqa: F401
