"""Search patterns: what the user types, as a regular expression for the JVM or for Python.

Patterns follow Python's ``re``. The JVM runs the ones that mean the same there; the rest
go through an Arrow UDF over ``re.finditer`` (see ``operators.concordance``).
"""

from __future__ import annotations

import re
import re._parser as sre
from dataclasses import dataclass
from functools import cached_property

# Regular expressions built from these parts only mean the same to Java and to Python.
_PLAIN = r"[^\\\[\](){}|?*+.^$]"
_ESCAPE = r"\\[dDwWsSbBtn.\\\[\](){}|?*+^$/\-]"
_CLASS = r"\[\^?(?:[^\\\[\]&]|\\[dwstn\\\]\[^\-])+\]"
_REPEAT = r"[*+?]\??|\{\d+(?:,\d*)?\}\??"
_LOOK = r"\((?:\?[:=!]|(?!\?))"
_SHARED_SYNTAX = re.compile(rf"(?:{_PLAIN}|{_ESCAPE}|{_CLASS}|{_REPEAT}|{_LOOK}|\)|[|.^$])+")

# The classes of Python's ``re`` for text, spelled out for Java, whose own differ (combining marks).
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
_JAVA_CLASS = {"w": _WORD, "d": r"\p{Nd}", "s": _SPACE}
_JAVA = {
    "w": f"[{_WORD}]",
    "W": f"[^{_WORD}]",
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": f"[{_SPACE}]",
    "S": f"[^{_SPACE}]",
    "b": f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))",
    "B": f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))",
}
_TOKEN = re.compile(rf"{_CLASS}|\\.")


def _java_token(token: re.Match[str]) -> str:
    found = token.group()
    if found[0] == "\\":
        return _JAVA.get(found[1], found)
    return re.sub(r"\\(.)", lambda m: _JAVA_CLASS.get(m.group(1), m.group()), found)


@dataclass(frozen=True)
class SearchPattern:
    """A keyword or regular expression together with its search options."""

    keyword: str
    regex: bool = False
    ignore_case: bool = True
    whole_word: bool = False

    def __post_init__(self) -> None:
        if not self.keyword:
            raise ValueError("the keyword is empty")
        try:
            self.compiled  # noqa: B018 - compile now, so that a bad pattern fails before planning
        except re.error as error:
            raise ValueError(f"invalid regular expression {self.keyword!r}: {error}") from error

    def _wrap(self, body: str) -> str:
        return rf"\b{body}\b" if self.whole_word else body

    @cached_property
    def python(self) -> str:
        """The pattern for Python's ``re``."""
        return self._wrap(self.keyword if self.regex else re.escape(self.keyword))

    @cached_property
    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.python, self.flags)

    @property
    def flags(self) -> int:
        return re.IGNORECASE if self.ignore_case else 0

    @cached_property
    def java(self) -> str:
        """The pattern for Spark: classes as in Python, ``\\n`` as the only line end."""
        body = _TOKEN.sub(_java_token, self.keyword) if self.regex else self._quoted()
        if self.whole_word and self.regex:
            body = f"{_JAVA['b']}{body}{_JAVA['b']}"
        elif self.whole_word:  # the border of a known character needs a look at one side only
            first, last = (re.match(r"\w", c) is not None for c in (self.keyword[0], self.keyword[-1]))
            body = f"(?<{'!' if first else '='}[{_WORD}]){body}(?{'!' if last else '='}[{_WORD}])"
        return ("(?iud)" if self.ignore_case else "(?d)") + body

    def _quoted(self) -> str:
        # A \E inside the keyword would end the quotation: close it, write \E escaped, reopen.
        return r"\Q" + self.keyword.replace(r"\E", r"\E\\E\Q") + r"\E"

    @cached_property
    def in_jvm(self) -> bool:
        """Can Spark's own functions find the matches?

        They cannot where a match may be empty, or where the two dialects differ.
        """
        if not self.regex:
            return True
        smallest = sre.parse(self.python, self.flags).getwidth()[0]
        return smallest > 0 and _SHARED_SYNTAX.fullmatch(self.keyword) is not None


def pattern_error(keyword: str, **options: bool) -> str | None:
    """Why a regular expression does not compile, or ``None`` when it does."""
    try:
        SearchPattern(keyword, regex=True, **options)
    except ValueError as error:
        return str(error)
    return None
