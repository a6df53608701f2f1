"""Declared schemas and class names."""

from __future__ import annotations

# Schema as DDL, for readers that must not infer it.
METRICS = "`set` STRING, metric STRING, value DOUBLE"

# Class names by class id, the label of non-arguments, content columns.
COMPONENT_LABELS = ("premise", "claim")
RELATION_LABELS = ("none", "inference", "conflict", "rephrase")
STANCE_LABELS = ("neither", "support", "attack")
NULL_RELATIONS = ("none", "neither")
NOT_ARGUMENTATIVE = "NoArgument"
CONTENT_COLUMNS = ("main_content", "plain_text")
