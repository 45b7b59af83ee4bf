"""Reusable DataFrame operators: joins, quantiles, clustering, kriging."""
