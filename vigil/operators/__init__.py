"""Operators: line model, facts, detectors, rule-pack scan, graph, summaries, SARIF."""
