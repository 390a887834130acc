"""Registered queries over the driver tables and their SQL."""

from __future__ import annotations

from recordloom.plans import intake_plans, mining_plans, staging, view_plans

QUERIES = {**staging.QUERIES, **intake_plans.QUERIES, **mining_plans.QUERIES, **view_plans.QUERIES}
SQL = {**staging.SQL, **intake_plans.SQL, **mining_plans.SQL, **view_plans.SQL}
