"""Corpus scan-and-rewrite jobs on Spark."""

from shiftwright.catalog import Catalog, Check, Rule, default_catalog, template_rules
from shiftwright.plans.migrate import Run, dry_run, migrate

__all__ = [
    "Catalog", "Check", "Rule", "Run", "default_catalog", "dry_run", "migrate", "template_rules",
]
