"""Fixtures of awkward rows and plain counterparts of what the operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
        out.append(w + (".\n" if i % 17 == 16 else " "))
    return "".join(out).strip()


def awkward_docs() -> list[tuple]:
    """Nulls, empty and white texts, repeated rows, ties, shared passages, a long text, odd characters."""
    passage = prose(1, 60)
    texts = [
        None, "", " \t\n ", "one", "two words", passage, passage, f"{prose(2, 40)} {passage} {prose(3, 20)}",
        f"{prose(4, 10)} {passage}", f"{passage} {passage}", "la " * 300, prose(5, 4000), prose(5, 4000) + " end",
        "ünï çödé \u3000 x\u00a0y \U0001f389 " * 40, "a\x1cb \x85c " * 50, prose(6, 120), prose(6, 120).upper(),
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, prose(7, 80), None, None, None), (3, "a second text with the id three", "en", "s0", 1)]


def components(n: int, links) -> list[int]:
    """Smallest index reachable from each of ``n`` indices."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
