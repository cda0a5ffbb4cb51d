"""The same questions in plain SQL, for an engine that reads the same tables."""

from __future__ import annotations

import re

#: name -> body of a common table expression; bodies may use earlier names and the base tables.
CTES: dict[str, str] = {}
#: Names whose rows are kept, because a query or later names read them more than once.
KEPT: set[str] = set()


def cte(name: str, body: str, kept: bool = False) -> None:
    CTES[name] = body.strip()
    if kept:
        KEPT.add(name)


def sql(body: str) -> str:
    """Prefix ``body`` with every common table expression it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(body)
    if not needed:
        return body.strip()
    parts = [f"{name} AS {'MATERIALIZED ' if name in KEPT else ''}({CTES[name]})" for name in CTES if name in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()

