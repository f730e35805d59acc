"""Whole pipelines: model runs, reports and the registered queries."""
