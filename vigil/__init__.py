"""vigil: a Spark-native source-code audit engine.

Files or any text table -> line DataFrame -> structural facts -> findings,
summaries, call graph, taint points and SARIF rows, all as DataFrame plans.
"""
__version__ = "0.1.0"
