"""Registered queries: operators applied to whole tables, with SQL for those that SQL can express."""

from panelyard.plans import analytics, files, genomes, panels, payload_plans, records, reports, rules, sequences, streams
from panelyard.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "files", "genomes", "panels", "payload_plans", "records", "reports", "rules", "sequences", "streams"]
