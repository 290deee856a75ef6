"""Resolving a file's header to canonical fields: driver-side work on a handful of names."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from ..errors import InvalidRequestError

#: Least similarity of a fuzzy hit, and least lead over the runner-up.
ACCEPT, LEAD = 0.85, 0.05
REQUIRED = ("consumer_id", "timestamp", "value_mw")
UNITS = ("MW", "kW")
#: Last words of a header that state a power unit, or something that is none.
POWER_WORDS = ("mw", "kw")
ENERGY_WORDS = ("mwh", "kwh", "wh", "w", "hour")


def normalize_name(name: str) -> str:
    """Compatibility form, case folded, with everything but letters, digits and marks as single spaces."""
    folded = unicodedata.normalize("NFKC", name).strip().casefold()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in folded).split())


@dataclass(frozen=True)
class Field:
    name: str
    aliases: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class Match:
    """``status``: exact, fuzzy, ambiguous or unresolved."""

    header: str
    status: str
    field: str | None = None
    confidence: float = 0.0


@dataclass(frozen=True)
class Resolution:
    matches: tuple[Match, ...]
    missing: tuple[str, ...]
    collisions: tuple[str, ...]

    @property
    def usable(self) -> bool:
        return not self.missing and not self.collisions and all(m.status != "ambiguous" for m in self.matches)

    def columns(self) -> dict[str, int]:
        return {m.field: i for i, m in enumerate(self.matches) if m.field}


@dataclass(frozen=True)
class Resolver:
    fields: tuple[Field, ...]
    _exact: dict[str, str] = field(init=False, default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if not self.fields:
            raise InvalidRequestError("no fields are configured")
        names = [(f.name, f.name) for f in self.fields] + [(a, f.name) for f in self.fields for a in f.aliases]
        if len({f.name for f in self.fields}) != len(self.fields):
            raise InvalidRequestError("a field is configured twice")
        for text, target in names:
            key = normalize_name(text)
            if not key or self._exact.setdefault(key, target) != target:
                raise InvalidRequestError("a header name is empty or belongs to two fields")

    def match(self, header: str) -> Match:
        key = normalize_name(header)
        if not key:
            return Match(header, "unresolved")
        if key in self._exact:
            return Match(header, "exact", self._exact[key], 1.0)
        best: dict[str, float] = {}
        for known, target in self._exact.items():
            ratio = SequenceMatcher(None, key, known, autojunk=False).ratio()
            best[target] = max(best.get(target, 0.0), ratio)
        ranked = sorted(((s, t) for t, s in best.items() if s >= ACCEPT), key=lambda p: (-p[0], p[1]))
        if not ranked:
            return Match(header, "unresolved")
        if len(ranked) > 1 and ranked[0][0] - ranked[1][0] < LEAD:
            return Match(header, "ambiguous", None, ranked[0][0])
        return Match(header, "fuzzy", ranked[0][1], ranked[0][0])

    def settle(self, matches: tuple[Match, ...]) -> Resolution:
        hit = [m.field for m in matches if m.field]
        missing = tuple(f.name for f in self.fields if f.required and f.name not in hit)
        return Resolution(matches, missing, tuple(sorted({f for f in hit if hit.count(f) > 1})))

    def resolve(self, headers: list[str]) -> Resolution:
        return self.settle(tuple(self.match(h) for h in headers))


def consumption_fields(unit: str = "MW") -> tuple[Field, ...]:
    """The three fields of a consumption file; the value may be headed by the configured unit."""
    if unit not in UNITS:
        raise InvalidRequestError("unsupported power unit")
    return (Field("consumer_id"), Field("timestamp"), Field("value_mw", (f"Consumption_{unit}",)))


def require_consumption_fields(fields: tuple[Field, ...]) -> tuple[Field, ...]:
    if sorted(f.name for f in fields) != sorted(REQUIRED) or not all(f.required for f in fields):
        raise InvalidRequestError("consumption needs exactly its three fields")
    return fields


def claims_energy(words: list[str]) -> bool:
    """A header that ends in a unit of energy, or in a bare watt, is no power in the configured unit."""
    return words[-1:] != [] and (words[-1] in ENERGY_WORDS or words[-2:] == ["mw", "h"])


def safe_units(resolver: Resolver, found: Resolution, unit: str) -> Resolution:
    """Withdraw hits for ``value_mw`` whose header does not state the configured power unit safely.

    A fuzzy hit must end in that unit; an exact one must not end in an energy unit or in the other
    power unit. Nothing is converted here.
    """
    out = []
    for m in found.matches:
        if m.field == "value_mw":
            words = normalize_name(m.header).split()
            last = words[-1] if words else ""
            other = last != unit.lower() if m.status == "fuzzy" else last in POWER_WORDS and last != unit.lower()
            if other or claims_energy(words):
                m = Match(m.header, "unresolved")
        out.append(m)
    return resolver.settle(tuple(out))


def diagnostics(found: Resolution) -> list[dict]:
    """Errors for missing, ambiguous and colliding fields; warnings for fuzzy and unresolved headers."""
    out = [{"code": "schema_field_missing", "severity": "error", "field_name": f} for f in found.missing]
    out += [{"code": "schema_field_ambiguous", "severity": "error", "field_name": None} for m in found.matches if m.status == "ambiguous"]
    out += [{"code": "schema_field_collision", "severity": "error", "field_name": f} for f in found.collisions]
    out += [{"code": "schema_field_fuzzy", "severity": "warning", "field_name": m.field} for m in found.matches if m.status == "fuzzy"]
    out += [{"code": "schema_field_unresolved", "severity": "warning", "field_name": None} for m in found.matches if m.status == "unresolved"]
    return out
