"""Python's regular expressions, translated for the JVM's engine.

The reference searches titles with Python's pattern syntax. The pattern is parsed by Python itself
and written out anew, element by element, in the JVM's syntax with Python's meaning: ``\\d``, ``\\w``,
``\\s`` and ``\\b`` know all of Unicode, ``.`` stops at line feeds only, ``$`` also matches before a last
line feed, ``\\Z`` only at the end, ``(?P<x>..)`` and ``(?P=x)`` become numbered groups, ``(?i)``
folds all letters. What has no equal (conditional groups, locale or byte patterns, look-behinds of varying
width) is refused here, on the driver, instead of failing or differing in a task.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as parser

# The classes of Python's str patterns.
_CLASSES = {
    "digit": (r"\p{Nd}", r"0-9"),
    "space": ("\\t-\\r\\x1c-\\x1f\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}",
              r"\t-\r\x20"),
    "word": (r"\p{L}\p{N}_", r"a-zA-Z0-9_"),
}
_CATEGORIES = {
    K.CATEGORY_DIGIT: ("digit", False), K.CATEGORY_NOT_DIGIT: ("digit", True),
    K.CATEGORY_SPACE: ("space", False), K.CATEGORY_NOT_SPACE: ("space", True),
    K.CATEGORY_WORD: ("word", False), K.CATEGORY_NOT_WORD: ("word", True),
}
_FLAGS = {K.SRE_FLAG_IGNORECASE: "iu", K.SRE_FLAG_DOTALL: "", K.SRE_FLAG_MULTILINE: "", K.SRE_FLAG_VERBOSE: "",
          K.SRE_FLAG_UNICODE: "", K.SRE_FLAG_ASCII: ""}


class PatternError(ValueError):
    """The pattern is no regular expression, or has no equal on the JVM."""


def _char(code: int) -> str:
    return chr(code) if chr(code).isalnum() and code < 128 else f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, flags: int):
        self.flags = flags

    def _class(self, name: str) -> str:
        return _CLASSES[name][1 if self.flags & K.SRE_FLAG_ASCII else 0]

    def sequence(self, items) -> str:
        return "".join(self.item(op, value) for op, value in items)

    def item(self, op, value) -> str:
        write = getattr(self, f"_{str(op).lower()}", None)
        if write is None:
            raise PatternError(f"{str(op).lower()} has no equal")
        return write(value)

    def _literal(self, code) -> str:
        return self._folded([(K.LITERAL, code)], _char(code))

    def _not_literal(self, code) -> str:
        return self._in([(K.NEGATE, None), (K.LITERAL, code)])

    def _any(self, _) -> str:
        return r"[\s\S]" if self.flags & K.SRE_FLAG_DOTALL else r"[^\n]"

    def _folded(self, items, text: str) -> str:
        """Python folds a few letters that the JVM does not, whole (the other way round it is the same): the dotted
        and dotless i, long s, Kelvin and Angstrom signs are given as alternatives."""
        if not self.flags & K.SRE_FLAG_IGNORECASE or self.flags & K.SRE_FLAG_ASCII:
            return text
        same = {ord(c): group for group in ("iIİı", "sSſ", "kKK", "åÅÅ", "µμΜ", "ßẞ") for c in group}
        code = items[0][1]
        return "[" + "".join(_char(ord(c)) for c in same[code]) + "]" if code in same else text

    def _in(self, items) -> str:
        negated = items[0][0] is K.NEGATE
        out = []
        for op, value in items[1:] if negated else items:
            if op is K.LITERAL:
                one = self._folded([(op, value)], _char(value))
                out.append(one[1:-1] if one.startswith("[") else one)
            elif op is K.RANGE:
                out.append(f"{_char(value[0])}-{_char(value[1])}")
            elif op is K.CATEGORY:
                name, other = _CATEGORIES[value]
                out.append(f"[{'^' if other else ''}{self._class(name)}]")
            else:
                raise PatternError(f"{str(op).lower()} in a set has no equal")
        return f"[{'^' if negated else ''}{''.join(out)}]"

    def _branch(self, value) -> str:
        return "(?:" + "|".join(self.sequence(b) for b in value[1]) + ")"

    def _repeat(self, value, kind: str) -> str:
        least, most, items = value
        if most is K.MAXREPEAT:
            count = {0: "*", 1: "+"}.get(int(least), f"{{{least},}}")
        else:
            count = "?" if (least, most) == (0, 1) else f"{{{least},{most}}}"
        return f"(?:{self.sequence(items)}){count}{kind}"

    def _max_repeat(self, value) -> str:
        return self._repeat(value, "")

    def _min_repeat(self, value) -> str:
        return self._repeat(value, "?")

    def _possessive_repeat(self, value) -> str:
        return self._repeat(value, "+")

    def _atomic_group(self, value) -> str:
        return f"(?>{self.sequence(value)})"

    def _subpattern(self, value) -> str:
        group, add, remove, items = value
        old = self.flags
        self.flags = (old | add) & ~remove
        inside = self.sequence(items)
        on = bool(self.flags & K.SRE_FLAG_IGNORECASE)
        if on != bool(old & K.SRE_FLAG_IGNORECASE):
            inside = ("(?iu:" if on else "(?-iu:") + inside + ")"
        self.flags = old
        return f"({inside})" if group is not None else f"(?:{inside})"

    def _groupref(self, group) -> str:
        return f"(?:\\{group})"

    def _assert(self, value) -> str:
        return self._look(value, "=")

    def _assert_not(self, value) -> str:
        return self._look(value, "!")

    def _look(self, value, sign: str) -> str:
        direction, items = value
        if direction < 0 and len(set(items.getwidth())) != 1:
            raise PatternError("a look-behind of varying width")
        return f"(?{'<' if direction < 0 else ''}{sign}{self.sequence(items)})"

    def _failure(self, _) -> str:
        return "(?!)"

    def _at(self, where) -> str:
        w = f"[{self._class('word')}]"
        many = bool(self.flags & K.SRE_FLAG_MULTILINE)
        return {
            K.AT_BEGINNING: r"(?:\A|(?<=\n))" if many else r"\A",
            K.AT_BEGINNING_STRING: r"\A",
            K.AT_END: r"(?=\n|\z)" if many else r"(?=\n?\z)",
            K.AT_END_STRING: r"\z",
            K.AT_BOUNDARY: f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))",
            K.AT_NON_BOUNDARY: f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))",
        }[where]


def to_jvm(pattern: str) -> str:
    """The JVM's pattern that finds what Python's ``re.search(pattern, ...)`` finds."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise PatternError(f"not a regular expression: {e}") from e
    flags = parsed.state.flags
    unknown = flags & ~sum(_FLAGS)
    if unknown:
        raise PatternError(f"flags {re.RegexFlag(unknown)!r} have no equal")
    out = _Writer(flags).sequence(parsed)
    return f"(?iu){out}" if flags & K.SRE_FLAG_IGNORECASE else out
