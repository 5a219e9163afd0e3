"""Imports every query module, in inventory order."""

from . import q_views, q_merge, q_spine, q_rules, q_checks, q_flags, q_ledger, q_coverage, q_oplog, q_pages, q_files, q_streams, q_loads  # noqa: F401
