"""DuckDB SQL that states the expected result of every registered query.

Named common table expressions live in one library; ``with_ctes`` puts in front
of a final SELECT exactly those it (transitively) mentions.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
RECURSIVE: set[str] = set()


def define(name: str, sql: str, recursive: bool = False) -> None:
    assert name not in CTES, name
    CTES[name] = sql.strip()
    if recursive:
        RECURSIVE.add(name.split("(")[0])


def _mentions(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_][a-z_0-9]*", sql)) & set(CTES)


def with_ctes(final: str) -> str:
    needed: set[str] = set()
    queue = list(_mentions(final))
    while queue:
        name = queue.pop()
        if name in needed:
            continue
        needed.add(name)
        queue.extend(_mentions(CTES[name]) - {name})
    if not needed:
        return final.strip()
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed]
    word = "WITH RECURSIVE" if needed & RECURSIVE else "WITH"
    return f"{word} " + ",\n".join(parts) + "\n" + final.strip()
