"""The project's reference lists as gazetteers: ministries, directions and their offices."""

from __future__ import annotations

import re
from collections.abc import Callable

from corvane.llm.matching import NONE, STOP, Gazetteer, Trie, allowed, joined_letters, leading_words, plain

_CODE = re.compile(r"(?<![^\W_])(?:sd\s*(\d+)\s*[/\-. ]\s*)?(\d+)\s*([a-z])(?![^\W_])")
_BRACKET = re.compile(r"^\s*\[\s*([^\]/]*?)\s*/\s*([^\]]*?)\s*\]\s*(.*)$", re.S)


def ministry_matcher(entries: list[tuple]) -> Callable[[str | None], list[tuple[str, int]]]:
    """``entries``: id, full title, short label."""
    names = Gazetteer(leading_words([title for _, title, _ in entries]))
    for ident, title, short in entries:
        names.add(title, ident)
        names.add(short, ident)

    def match(value: str | None) -> list[tuple[str, int]]:
        return [] if value is None else [("ministre_libelle", names.search(value))]

    return match


class Directions:
    """``entries``: id, acronym, full name."""

    def __init__(self, entries: list[tuple]):
        self.names = Gazetteer()
        self.acronyms = Trie()
        #: The words that names begin with, which are typed short.
        self.units: set[str] = set()
        for ident, acronym, name in entries:
            self.names.add(name, ident)
            self.units |= {w for w in plain(name or "")[:2] if w not in STOP}
            if acronym and (words := joined_letters(plain(acronym))):
                self.acronyms.add("".join(words), ident)
        self.known: dict[str, int] = {}

    def spell(self, words: list[str]) -> list[str]:
        """Shortened kinds of unit written out: a word of three letters or more that begins exactly one kind, or one with its feminine."""
        out = []
        for i, w in enumerate(words):
            full = sorted(u for u in self.units if i < 2 and 3 <= len(w) < len(u) and u.startswith(w))
            out.append(full[0] if full and all(u.startswith(full[0]) for u in full) else w)
        return out

    def search(self, value: str | None) -> int:
        if value is None:
            return NONE
        if (got := self.known.get(value)) is None:
            got = self._search(value)
            if len(self.known) < 1_000_000:
                self.known[value] = got
        return got

    def _search(self, value: str) -> int:
        words = joined_letters(plain(value))
        # an acronym is an alias path of one word, wherever it stands in the value
        near = [self.acronyms.within(w, allowed(len(w))) for w in words]
        least = min((d for found in near for d in found.values()), default=0)
        by_acronym = {e for found in near for e, d in found.items() if d == least}
        if len(by_acronym) == 1:
            return by_acronym.pop()
        return self.names.search(" ".join(self.spell(words)))


class Offices:
    """``entries``: id, ``[SUB/CODE] name``, direction id."""

    def __init__(self, entries: list[tuple]):
        parsed = []
        for ident, label, direction in entries:
            if not label:
                continue
            m = _BRACKET.match(label)
            sub, code, name = m.groups() if m else ("", "", label)
            parsed.append((ident, direction, "".join(plain(sub)), "".join(plain(code)), name))
        self.names = Gazetteer(leading_words([name for *_, name in parsed]))
        self.of: dict[int, tuple[int, str, frozenset[str]]] = {}
        #: Codes alone, and with the sub-direction before.
        self.codes = Trie()
        for ident, direction, sub, code, name in parsed:
            self.names.add(name, ident)
            self.of[ident] = (direction, sub, frozenset(plain(name)))
            if code:
                self.codes.add(code, ident)
                self.codes.add(f"{sub} {code}", ident)

    def search(self, value: str, direction: int, sub: str | None) -> int:
        sub = "".join(plain(sub)) if sub else ""

        def fits(e: int) -> bool:
            d, s, _ = self.of[e]
            return (direction == NONE or d == direction) and (not sub or s == sub)

        folded = " ".join(plain(value))
        for m in _CODE.finditer(folded):
            code = m[2] + m[3]
            # a code is an alias path of its own; what it names inside the direction is meant, with the words beside it where they are several
            among = [e for e in self.codes.within(f"sd{m[1]} {code}" if m[1] else code, 0) if fits(e)]
            if len(among) == 1:
                return among[0]
            if among:
                beside = [w for w in plain(folded[: m.start()] + " " + folded[m.end() :]) if not self.names.foreign(w) and not self.names.is_head(w)]
                named = [e for e in among if beside and self.of[e][2].issuperset(beside)]
                return named[0] if len(named) == 1 else NONE
        return self.names.search(value, fits)


def office_matcher(directions: list[tuple], offices: list[tuple]) -> Callable[..., list[tuple[str, int]]]:
    """Of a direction, sub-direction and office as typed: the direction and the office meant inside it."""
    units, rooms = Directions(directions), Offices(offices)

    def match(direction: str | None, sub: str | None, office: str | None) -> list[tuple[str, int]]:
        out = []
        unit = units.search(direction)
        if direction is not None:
            out.append(("direction_txt", unit))
        if office is not None:
            out.append(("bureau", rooms.search(office, unit, sub)))
        return out

    return match
