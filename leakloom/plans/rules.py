"""Detection rules and their JSON form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from leakloom.functions.findings import SEVERITIES
from leakloom.functions.regex import to_python

#: The fields of a custom rule.
FIELDS = ("name", "keywords", "regex", "entropy_min", "severity", "verify_url", "verify_header", "help_uri", "description")


@dataclass(frozen=True)
class Rule:
    """One detector as data: what it looks for, in which company, and what a finding means.

    ``patterns`` are its token forms; the secret is the first group that took part, of ``groups`` if given, else of
    the first one, else the whole match. ``partner`` is to be found within ``partner_radius`` of the secret, nearest
    first, or is a group of the same match; words of ``context`` or patterns of ``arms`` must stand within ``radius``. Distances are in bytes.
    """

    name: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]
    groups: tuple[int, ...] | None = None
    partner: str | None = None
    partner_radius: int = 256
    context: tuple[str, ...] = ()
    arms: tuple[str, ...] = ()
    radius: int = 0
    min_entropy: float = 0.0
    severity: int | None = None
    verifier_backed: bool = False
    whole_text: bool = False
    shown: int = 6
    family: str = "REGEX"
    left_boundary: bool = False
    stop: tuple[str, ...] = ()
    partner_group: int | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)


def load_custom(text: str) -> list[Rule]:
    """Rules from a JSON array; unknown fields, no keyword, no pattern and bad patterns are errors.

    The secret is the whole match, whatever its groups. Severity is info by default.
    """
    rows = json.loads(text)
    if not isinstance(rows, list) or not rows:
        raise ValueError("a non-empty array of rules is needed")
    out = []
    for i, row in enumerate(rows):
        if unknown := set(row) - set(FIELDS):
            raise ValueError(f"rule {i}: unknown fields {sorted(unknown)}")
        if not (row.get("name") or "").strip() or not row.get("keywords") or not row.get("regex"):
            raise ValueError(f"rule {i}: name, keywords and regex are needed")
        try:
            re.compile(to_python(row["regex"]))
        except re.error as e:
            raise ValueError(f"rule {i}: {e}") from e
        severity = (row.get("severity") or "info").strip().lower() or "info"
        if severity not in SEVERITIES:
            raise ValueError(f"rule {i}: severity {severity!r}")
        rank = max(k for k, name in enumerate(SEVERITIES) if name == severity)
        out.append(Rule(row["name"], tuple(k.lower() for k in row["keywords"]), (row["regex"],), (0,), min_entropy=float(row.get("entropy_min", 0)), severity=rank, family="CUSTOM", extra={k: row[k] for k in ("help_uri", "description") if k in row}))
    return out


def select(rules: list[Rule], include=(), exclude=()) -> list[Rule]:
    """Rules by case-insensitive names, include first, then exclude; unknown names are errors; custom rules always pass."""
    known = {r.name.lower() for r in rules}
    for name in (*include, *exclude):
        if name.lower() not in known:
            raise ValueError(f"unknown detector {name!r}")
    wanted, unwanted = {n.lower() for n in include}, {n.lower() for n in exclude}
    return [r for r in rules if r.family == "CUSTOM" or (not wanted or r.name.lower() in wanted) and r.name.lower() not in unwanted]
