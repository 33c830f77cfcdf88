"""Operators for training data. Nothing outside this subpackage imports it."""

#: Modules whose QUERIES and SQL the driver contract adds.
MODULES = ["tallymill.llm.queries"]
