"""A dialect bundles what differs between log formats.

Users extend the engine here: a new dialect is a new ``Dialect`` value, no code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from augurlog.functions import packs


@dataclass(frozen=True)
class Dialect:
    """One log format.

    ``timestamp_style``: ``"syslog"`` (no year; the caller names it) or ``"iso"``.
    ``carry_forward``: a line without header takes time and process of the last
    line that had one, as multi-line servicing logs need.
    """

    name: str
    line_pattern: str
    keywords: dict[str, str] = field(default_factory=dict)
    rules: tuple[tuple[str, str], ...] = ()
    timestamp_style: str = "syslog"
    carry_forward: bool = False
    fixed_host: str | None = None


LINUX = Dialect("linux", packs.LINUX_LINE, packs.LINUX_KEYWORDS, tuple(packs.LINUX_RULES))
MAC = Dialect("mac", packs.MAC_LINE, packs.MAC_KEYWORDS, tuple(packs.MAC_RULES))
WINDOWS = Dialect(
    "windows",
    packs.WINDOWS_LINE,
    packs.WINDOWS_KEYWORDS,
    tuple(packs.WINDOWS_RULES),
    timestamp_style="iso",
    carry_forward=True,
    fixed_host=packs.WINDOWS_HOST,
)

DIALECTS = {d.name: d for d in (LINUX, MAC, WINDOWS)}


def dialect(name: str | Dialect) -> Dialect:
    """Look a dialect up by name; a ``Dialect`` passes through."""
    if isinstance(name, Dialect):
        return name
    try:
        return DIALECTS[name]
    except KeyError:
        raise ValueError(f"unknown dialect {name!r}; known: {sorted(DIALECTS)}") from None
