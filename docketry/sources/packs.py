"""Rule packs: JSON to checked rules, and the choice of a pack per county."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..functions import regex as R

SHIPPED = Path(__file__).resolve().parent.parent / "packs"


@dataclass(frozen=True)
class RulePack:
    """Rules of one pack; ``counties`` are all counties it applies to."""

    counties: tuple[str, ...]
    rules: dict = field(hash=False)
    order: tuple[str, ...] = ()

    @property
    def fields(self) -> list[str]:
        """Fields in extraction order; listed fields without a rule are skipped."""
        return [f for f in self.order if f in self.rules]

    def for_counties(self, counties: Iterable[str]) -> "RulePack":
        return replace(self, counties=tuple(counties))

    def same_rules(self, other: "RulePack") -> bool:
        return self.rules == other.rules and self.order == other.order


def parse_pack(text: str) -> RulePack:
    data = json.loads(text)
    rules = data.get("patterns", {})
    order = tuple(data.get("extraction_order", list(rules)))
    for name, rule in rules.items():
        check_rule(name, rule)
    return RulePack((data.get("county", ""),), rules, order)


def check_rule(name: str, rule: dict) -> None:
    """Refuse rules which would fail on every document or match nothing at all."""
    kind = rule.get("type", "")
    for key in ("regex", "date_regex"):
        used = (key == "regex") == (kind == "regex") and kind in ("regex", "facts_pattern")
        if used and rule.get(key) and not R.is_valid(rule[key]):
            raise ValueError(f"rule {name}: {key} does not compile")
    listed = [p.get("regex", "") for p in rule.get("patterns", [])] if kind == "multi_pattern" else []
    listed += rule.get("date_patterns", []) if kind == "multi_date" else []
    for pattern in listed:
        if pattern and R.is_valid(pattern) and R.can_match_empty(pattern):
            raise ValueError(f"rule {name}: {pattern!r} can match the empty string")
    listed += [rule.get("regex"), rule.get("date_regex"), *rule.get("base_patterns", []), *rule.get("target_patterns", [])]
    for pattern in listed:
        if pattern and R.is_valid(pattern) and not R.has_java_spelling(pattern):
            raise ValueError(f"rule {name}: {pattern!r} has no spelling in Java")


def load_pack(path: str | Path) -> RulePack:
    return parse_pack(Path(path).read_text(encoding="utf-8"))


def shipped_pack(name: str = "orange") -> RulePack:
    return load_pack(SHIPPED / f"{name}_patterns.json")


def pack_for_county(county: str, folder: str | Path = SHIPPED) -> RulePack | None:
    """``<county>_patterns.json``, else a pack that names the county inside, else none."""
    folder = Path(folder)
    exact = folder / f"{county}_patterns.json"
    if exact.exists():
        return load_pack(exact)
    named = (load_pack(p) for p in sorted(folder.glob("*_patterns.json")))
    return next((p for p in named if county in p.counties), None)


def individual_pack(folder: str | Path = SHIPPED) -> RulePack | None:
    """The first pack of the folder by name; used for documents that come one by one."""
    first = next(iter(sorted(Path(folder).glob("*_patterns.json"))), None)
    return load_pack(first) if first else None


def merge_equal(packs: Iterable[RulePack]) -> list[RulePack]:
    """One pack per distinct rule set, counties joined."""
    merged: list[RulePack] = []
    for pack in packs:
        for i, known in enumerate(merged):
            if known.same_rules(pack):
                merged[i] = known.for_counties(known.counties + pack.counties)
                break
        else:
            merged.append(pack)
    return merged
