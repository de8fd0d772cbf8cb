"""The detector catalog: rules from a plain data file, whose path is a parameter.

The file is TOML, one table a detector; ``detectors.toml`` in this package is the default.
"""

from __future__ import annotations

import os
import tomllib
from functools import lru_cache
from importlib.resources import files

from leakloom.functions.findings import SEVERITIES
from leakloom.plans.rules import Rule

DETECTORS = os.environ.get("LEAKLOOM_DETECTORS") or os.path.join(os.path.dirname(os.path.abspath(__file__)), "detectors.toml")
#: Found by other means: by entropy (``operators.generic``) and by a model (``llm.pii_crf``).
ELSEWHERE = ("GenericHighEntropy", "PIIAnonymize", "PIIOpenAIPF")


def _rule(row: dict) -> Rule:
    severity = row.get("severity")
    group = row.get("group")
    return Rule(
        row["name"], tuple(k.lower() for k in row["keywords"]), tuple(row["patterns"]), None if group is None else tuple([group] if isinstance(group, int) else group),
        row.get("partner"), row.get("partner_radius", 256), tuple(row.get("context", ())), tuple(row.get("arm", ())), row.get("radius", 0), row.get("entropy", 0.0),
        None if severity is None else max(k for k, name in enumerate(SEVERITIES) if name == severity), row.get("verifier", False), row.get("whole_text", False), row.get("shown", 6), row["family"], row.get("left_boundary", False), tuple(row.get("stop", ())), row.get("partner_group"),
    )


@lru_cache(maxsize=4)
def load(path: str = DETECTORS) -> tuple[Rule, ...]:
    """All rules of a file, by name; a detector may have several token forms."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            text = file.read()
    elif path == DETECTORS:  # the package lies in an archive, as with --py-files
        text = files("leakloom.plans").joinpath("detectors.toml").read_text("utf-8")
    else:
        raise FileNotFoundError(path)
    return tuple(map(_rule, tomllib.loads(text)["detector"]))


def named(*names: str) -> tuple[Rule, ...]:
    known = {r.name: r for r in load()}
    return tuple(known[n] for n in names)
