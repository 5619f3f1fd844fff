"""Registered queries: importing this package registers them all."""

from tidemark.plans import registry, history_queries, alert_queries, rule_queries, record_queries, line_queries, water_queries, scenario_queries, response_queries, time_queries, path_queries  # noqa: F401, I001
