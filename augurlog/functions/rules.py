"""Regex rules as Catalyst expressions.

A label rule is defined on the whole text of a time window, so ``A.*B`` may find
``A`` in one line and ``B`` in a later one.  Building that text means pulling all
lines of a window into one task.  Instead a rule is read as alternatives of
ordered atoms (``A.*B`` is the chain ``[A, B]``); the window matches when

* one line matches the rule by itself, or
* the first line holding ``A`` comes before the last line holding ``B``.

Both are ``max``/``min`` aggregates with map-side combine, so a window of any
size is labelled without collecting it.  The reading is exact as long as lines
hold no line break and no atom can match across the line separator;
``chains`` refuses patterns for which that is not certain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# i: ignore case, u: by Unicode rules, U: Unicode classes for \b \w \s, d: "." stops at \n only
FLAGS = "(?iuUd)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_sql(text: str, pattern: str, lowered: str | None = None) -> str:
    """SQL for a case-insensitive search in ``text``; null text does not match.

    Most log lines match nothing, so a substring test runs before the regex: a text
    that holds none of the literals a match must contain is settled without it.
    Texts with characters outside ASCII go to the regex directly, as some of those
    fold to ASCII letters there but not in ``lower``.
    """
    found = f"rlike({text}, {quoted(FLAGS + pattern)})"
    must = literals(pattern)
    if must:
        low = lowered or f"lower({text})"
        holds = " OR ".join(f"contains({low}, {quoted(m)})" for m in must)
        found = f"((octet_length({text}) <> length({text}) OR {holds}) AND {found})"
    return f"coalesce({found}, false)"


def matches(text: str, pattern: str, lowered: str | None = None) -> Column:
    """``match_sql`` as a column; ``text`` and ``lowered`` are column names."""
    return F.expr(match_sql(text, pattern, lowered))


def literals(pattern: str) -> list[str] | None:
    """Lower-case substrings of which any match holds at least one; None if unknown."""
    found = []
    for alternative in _split_top_level(pattern, "|"):
        options = [o for o in _required(alternative) if o]
        if not options:
            return None
        # the option whose shortest member is longest rules out most texts
        found += max(options, key=lambda o: min(map(len, o)))
    return list(dict.fromkeys(found))


def _required(alternative: str) -> list[list[str]]:
    """What every match of one alternative contains: each entry lists substrings of
    which one is there (a plain run of characters, or the choices of a group)."""
    options, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        if run:
            options.append([run])
        run = ""

    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\":
            following = alternative[i + 1]
            if following.isalnum():
                end()
            else:
                run += following
            i += 2
            continue
        if ch in "([":
            end()
            close = _group_end(alternative, i)
            if ch == "(" and alternative[close : close + 1] not in ("?", "*", "{"):
                inside = alternative[i + 1 : close - 1]
                choices = None if inside.startswith("?") else literals(inside)
                if choices:
                    options.append(choices)
            i = close
            continue
        if ch in "?*{":
            run = run[:-1]
            end()
            if ch == "{":
                i = alternative.index("}", i)
        elif ch in "+.^$":
            end()
        else:
            run += ch.lower()
        i += 1
    end()
    return options


def _group_end(pattern: str, start: int) -> int:
    """Index after the group or class that opens at ``start``."""
    depth, in_class, i = 0, False, start
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        i += 1
        if depth == 0 and not in_class:
            return i
    raise ValueError(f"unclosed group in {pattern!r}")


def _split_top_level(pattern: str, separator: str) -> list[str]:
    """Split at ``separator`` outside groups, classes and escapes."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif depth == 0 and pattern.startswith(separator, i):
            parts.append(pattern[start:i])
            i += len(separator)
            start = i
            continue
        i += 1
    return parts + [pattern[start:]]


# An atom that holds one of these could reach over a line separator (or depends
# on where a line starts or ends), so its chain cannot be read line by line.
_UNSAFE = re.compile(
    r"(?<!\\)(?:\\\\)*(?:\.|\^|\$|\[\^|\(\?|\\[WSDBAZzGXRNHV1-9]|\\\|)|\\n|\\R"
)


def chains(pattern: str) -> list[list[str]]:
    """The alternatives of a rule, each as its ordered atoms."""
    out = []
    for alternative in _split_top_level(pattern, "|"):
        atoms = _split_top_level(alternative, ".*")
        for atom in atoms:
            if not atom or _UNSAFE.search(atom.replace(r"\.", "")):
                raise ValueError(
                    f"rule part {atom!r} may match across lines; label by text instead"
                )
        if len(atoms) > 3:
            raise ValueError(f"rule {pattern!r} chains more than three parts")
        out.append(atoms)
    return out


def decomposable(pattern: str) -> bool:
    """True if ``chains`` accepts the pattern."""
    try:
        chains(pattern)
    except ValueError:
        return False
    return True
