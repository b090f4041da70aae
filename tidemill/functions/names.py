"""Clean column names."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Names that get a trailing underscore because they cannot be used bare.
RESERVED_NAMES = frozenset({
    "all", "any", "as", "asc", "case", "check", "column", "default", "desc", "from", "group", "order", "primary",
    "references", "select", "table", "where",
})


def quoted(name: str) -> str:
    """Back-quote an identifier so that dots, blanks and brackets in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def snake_case(name: str) -> str:
    """Lower-case words joined by single underscores; never empty, numeric-first or reserved."""
    words = re.findall(r"\w+", name.lower())
    text = "_".join(part for word in words for part in word.split("_") if part)
    if not text:
        text = "col"
    if text[0].isdigit():
        text = f"c_{text}"
    return f"{text}_" if text in RESERVED_NAMES else text


def unique_names(names: Iterable[str]) -> list[str]:
    """Number repeats (``a, a, b`` gives ``a, a_1, b``) without ever reusing a name in the list.

    Names that occur as given keep their spelling: ``a, a, a_1`` gives ``a, a_2, a_1``. Spark
    compares names without case, so ``A`` and ``a`` count as the same.
    """
    names = list(names)
    given = {n.lower() for n in names}
    used: set[str] = set()
    out = []
    for name in names:
        candidate, i = name, 0
        while candidate.lower() in used or (i and candidate.lower() in given):
            i += 1
            candidate = f"{name}_{i}"
        used.add(candidate.lower())
        out.append(candidate)
    return out
