"""Registered queries over the driver's tables, with SQL oracles."""

from . import derived  # noqa: F401  registers the derived views
