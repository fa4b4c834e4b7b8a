"""Expressions of the listing rules, as SQL text for ``selectExpr`` and ``F.expr``.

A rule set is tens of thousands of expression nodes.  Text reaches the JVM in one
call per field; Column objects need one call per node, which took longer than the
job itself.  Every function takes and returns the text of one expression.
"""
