"""What a pattern can't match without: literals that one automaton looks for, so that patterns are tried only where one of theirs stands."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from re import _constants as op
from re import _parser as parser

import ahocorasick

from quillon.functions.spans import lowered


#: A literal, and whether a word must begin with it and end with it.
Literal = tuple[str, bool, bool]


def required(pattern: str) -> frozenset[Literal] | None:
    """Literals in lower case of which every match holds one at least; None if the pattern promises none."""
    return _required(parser.parse(lowered(pattern), re.ASCII), False, False)


def _white(token) -> bool:
    """One white space or more."""
    kind, value = token
    return kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0 and list(value[2]) == [(op.IN, [(op.CATEGORY, op.CATEGORY_SPACE)])]


def _required(tokens, left: bool, right: bool) -> frozenset[Literal] | None:
    """Of the promises that the parts of a sequence make, the one whose shortest literal is longest; left, right: a word's edge is there."""
    promises, run, edge = [], "", left
    tokens = list(tokens)
    for i, (kind, value) in enumerate([*tokens, (None, None)]):
        if kind is op.LITERAL:
            run += chr(value)
            continue
        after = right if kind is None else kind is op.AT and value is op.AT_BOUNDARY or _white((kind, value))
        if run:
            promises.append(frozenset([(run, edge and run[0].isalnum(), after and run[-1].isalnum())]))
            run, edge = "", False
        if kind is None:
            break
        following = tokens[i + 1] if i + 1 < len(tokens) else None
        behind = right if following is None else following == (op.AT, op.AT_BOUNDARY) or _white(following)
        own = None
        if kind is op.BRANCH:
            parts = [_required(x, edge, behind) for x in value[1]]
            own = frozenset().union(*parts) if all(parts) else None
        elif kind is op.SUBPATTERN:
            own = _required(value[-1], edge, behind)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            own = _required(value[2], False, False)
        if own:
            promises.append(own)
        edge = after
    return max(promises, key=lambda p: (min(len(x) + a + b for x, a, b in p), -len(p)), default=None)


def low(text: str) -> str:
    """Lower case at the same offsets: of a longer lower case only the first character counts."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x.lower()[0] for x in text)


class Automaton:
    """One Aho-Corasick automaton for the literals of many rules."""

    def __init__(self) -> None:
        self.rules: dict[str, set[tuple[int, bool, bool]]] = defaultdict(set)
        self.always: set[int] = set()
        self._built: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None}

    def add_words(self, rule: int, words) -> None:
        for w in words:
            self.rules[low(w)].add((rule, w[0].isalnum(), w[-1].isalnum()))

    def add_pattern(self, rule: int, pattern: str) -> None:
        found = required(pattern)
        if found:
            for x, begins, stops in found:
                self.rules[x].add((rule, begins, stops))
        else:
            self.always.add(rule)

    def hits(self, text: str, starts: list[int], ends: list[int]) -> dict[int, set[int]]:
        """For each stretch [start, end) that holds a literal, by its number: the rules whose patterns may match there."""
        out: dict[int, set[int]] = defaultdict(set)
        if self.always:
            out.update((i, set(self.always)) for i in range(len(starts)))
        if not self.rules:
            return out
        if self._built is None:
            self._built = ahocorasick.Automaton()
            for literal, rules in self.rules.items():
                self._built.add_word(literal, (len(literal), tuple(rules)))
            self._built.make_automaton()
        body = low(text)
        for last, (size, rules) in self._built.iter(body):
            first = last - size + 1
            i = bisect_right(starts, first) - 1
            if i < 0 or last >= ends[i]:
                continue
            before = first > 0 and _in_word(body[first - 1])
            behind = last + 1 < len(body) and _in_word(body[last + 1])
            for rule, begins, stops in rules:
                if not (begins and before or stops and behind):
                    out[i].add(rule)
        return out


def _in_word(x: str) -> bool:
    """Surely part of a word in any dialect."""
    return x.isalpha() or x.isdecimal()
