"""Many strings found in one pass over a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

try:
    import ahocorasick
except ImportError:  # then one alternation of all strings, which takes longer the more there are
    ahocorasick = None


def automaton(strings: list[str]):
    """What occurrences() needs to find any of the strings; None for none."""
    known = sorted(set(strings), key=lambda s: (-len(s), s))
    if not known:
        return None
    if ahocorasick is None:
        return re.compile(f"(?=({'|'.join(map(re.escape, known))}))"), {s: [t for t in known if s.startswith(t)] for s in known}
    found = ahocorasick.Automaton()
    for s in known:
        found.add_word(s, s)
    found.make_automaton()
    return found


def occurrences(found, text: str) -> Iterator[tuple[str, int]]:
    """(string, start) wherever one of the strings stands in text, those within others and overlapping ones too."""
    if found is None:
        return
    if isinstance(found, tuple):
        pattern, heads = found
        for m in pattern.finditer(text):
            for s in heads[m[1]]:
                yield s, m.start()
        return
    for end, s in found.iter(text):
        yield s, end - len(s) + 1
