"""Fixtures in small: documents with every awkward case, and plain versions of what operators compute."""

from __future__ import annotations

from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=None):
    """Documents 0.. with the given texts; pairs give their own id."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    return frame.selectExpr("*", *(extra or []))


def components(nodes, links):
    """Smallest node reachable from each node."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for node in sorted(nodes):
        if node in found:
            continue
        stack = [node]
        while stack:
            at = stack.pop()
            if at not in found:
                found[at] = node
                stack += near[at]
    return found
