"""What a collection declares, and the rules for it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

MOST_SEARCH, MOST_STRINGS, MOST_NUMBERS = 8, 8, 7


class ConfigError(ValueError):
    """A collection's configuration breaks a rule."""


@dataclass(frozen=True)
class SortKey:
    field: str
    order: str = "asc"

    def __post_init__(self):
        if self.order not in ("asc", "desc"):
            raise ConfigError(f"order of {self.field!r} is neither asc nor desc")


def sort_keys(keys: Sequence) -> tuple[SortKey, ...]:
    """Keys given as SortKey, ``(field, order)``, ``{"field", "order"}`` or ``"field:order"``."""
    out = []
    for k in keys:
        if isinstance(k, SortKey):
            out.append(k)
        elif isinstance(k, Mapping):
            out.append(SortKey(**k))
        elif isinstance(k, str):
            name, _, order = k.partition(":")
            out.append(SortKey(name, order or "asc"))
        else:
            out.append(SortKey(*k))
    return tuple(out)


def spec_id(keys: Sequence[SortKey]) -> str:
    return ",".join(f"{k.field}:{k.order}" for k in keys)


@dataclass(frozen=True)
class Term:
    """One summand of a rank profile.

    ``type``: field, flag (``equals``), set_boost (``set_key``), recency_decay
    (``half_life_ms``), geo_distance (``lat_field``, ``lng_field``, ``max_km``)
    or relevance.
    """

    id: str
    type: str
    weight: float
    field: str | None = None
    equals: str | None = None
    set_key: str | None = None
    half_life_ms: float | None = None
    lat_field: str | None = None
    lng_field: str | None = None
    max_km: float | None = None

    @property
    def fields(self) -> list[str]:
        if self.type == "geo_distance":
            return [self.lat_field, self.lng_field]
        return [] if self.type == "relevance" else [self.field]


TERM_TYPES = ("field", "flag", "set_boost", "recency_decay", "geo_distance", "relevance")


@dataclass(frozen=True)
class Profile:
    base: str
    terms: tuple[Term, ...]
    window: int | None = None


@dataclass(frozen=True)
class Collection:
    """``stored``: "all", "derived" (the fields that some role needs) or a list; where
    it is left open, a collection that is created stores all, one that is applied
    the derived fields.
    ``filters`` maps a field to "string" or "number"."""

    name: str
    search: tuple[str, ...]
    stored: str | tuple[str, ...] | None = None
    filters: Mapping[str, str] = field(default_factory=dict)
    facets: tuple[str, ...] = ()
    sorts: tuple[tuple[SortKey, ...], ...] = ()
    profiles: Mapping[str, Profile] = field(default_factory=dict)
    pending: tuple[str, ...] = ()

    @staticmethod
    def make(name, search, stored=None, filters=None, facets=(), sorts=(), profiles=None, pending=()) -> Collection:
        """From plain lists and dictionaries."""
        built = {
            k: p if isinstance(p, Profile) else Profile(p["base"], tuple(t if isinstance(t, Term) else Term(**t) for t in p["terms"]), p.get("window"))
            for k, p in (profiles or {}).items()
        }
        return Collection(
            name, tuple(search), stored if stored is None or isinstance(stored, str) else tuple(stored), dict(filters or {}), tuple(facets),
            tuple(sort_keys(s) for s in sorts), built, tuple(pending),
        )

    def as_dict(self) -> dict:
        return asdict(self)

    def with_pending(self, fields) -> Collection:
        return replace(self, pending=tuple(fields))


def derived_fields(c: Collection) -> list[str]:
    """Every field that some role refers to, in order of first mention."""
    names = [*c.search, *c.filters, *c.facets, *(k.field for s in c.sorts for k in s)]
    names += [f for p in c.profiles.values() for t in p.terms for f in t.fields]
    return list(dict.fromkeys(names))


def validate(c: Collection, enforce_caps: bool = False) -> None:
    """Raise ConfigError where a rule is broken."""
    kept = None if c.stored is None or isinstance(c.stored, str) else set(c.stored)
    if kept is None and c.stored not in (None, "all", "derived"):
        raise ConfigError("stored is 'all', 'derived' or a list of fields")
    for role, names in (("filters", c.filters), ("facets", c.facets), ("sorts", [k.field for s in c.sorts for k in s])):
        for f in names:
            if kept is not None and f not in kept:
                raise ConfigError(f"{role}: field {f!r} isn't among the stored fields")
    for f, kind in c.filters.items():
        if kind not in ("string", "number"):
            raise ConfigError(f"filters: type of {f!r} is neither string nor number")
    specs = {spec_id(s) for s in c.sorts}
    for name, p in c.profiles.items():
        if p.base not in specs:
            raise ConfigError(f"profile {name!r}: base {p.base!r} isn't a declared sort")
        seen = set()
        for t in p.terms:
            if t.id in seen:
                raise ConfigError(f"profile {name!r}: term {t.id!r} occurs twice")
            seen.add(t.id)
            if t.type not in TERM_TYPES:
                raise ConfigError(f"profile {name!r}: term {t.id!r} has unknown type {t.type!r}")
            if t.type == "recency_decay" and not (t.half_life_ms or 0) > 0:
                raise ConfigError(f"profile {name!r}: term {t.id!r} needs a positive half_life_ms")
            if t.type == "geo_distance" and not (t.max_km or 0) > 0:
                raise ConfigError(f"profile {name!r}: term {t.id!r} needs a positive max_km")
            for f in t.fields:
                if kept is not None and f not in kept:
                    raise ConfigError(f"profile {name!r}: field {f!r} isn't among the stored fields")
    if enforce_caps:
        for what, n, most in (
            ("search fields", len(set(c.search)), MOST_SEARCH),
            ("string filters", sum(k == "string" for k in c.filters.values()), MOST_STRINGS),
            ("number filters", sum(k == "number" for k in c.filters.values()), MOST_NUMBERS),
        ):
            if n > most:
                raise ConfigError(f"{n} {what}; at most {most} are allowed")


def structural(c: Collection) -> list[str]:
    return list(dict.fromkeys([*c.filters, *c.facets, *(k.field for s in c.sorts for k in s)]))


def diff(old: Collection | None, new: Collection) -> tuple[str, list[str]]:
    """("create" or "update", structural fields that are new)."""
    before = set(structural(old)) if old else set()
    return "update" if old else "create", [f for f in structural(new) if f not in before]
