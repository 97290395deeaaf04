"""Orderings: relevance positions, weighted blends, rank profiles and sort keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfire.config import Profile, SortKey, Term
from quillfire.functions.coerce import number, string

EARTH_KM = 6371.0


@dataclass(frozen=True)
class Context:
    """What rank terms may refer to: the time in epoch milliseconds, a place, sets of strings."""

    now: float | None = None
    origin: tuple[float, float] | None = None
    sets: Mapping[str, list[str]] = field(default_factory=dict)


def num_field(df: DataFrame, name: str) -> Column:
    """A number to sort or weigh by; what is missing or no number is 0."""
    return F.coalesce(number(df, name), F.lit(0.0))


def synth_score(pos: Column, total: Column) -> Column:
    """1 for the first of ``total``, falling evenly; 0 where there is nothing."""
    return F.when(total > 0, (total - pos) / total).otherwise(0.0)


def haversine_km(lat1: float, lng1: float, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(F.lit(lat1))) / 2), 2) + F.cos(F.radians(F.lit(lat1))) * F.cos(F.radians(lat2)) * F.pow(
        F.sin((F.radians(lng2) - F.radians(F.lit(lng1))) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def term_value(df: DataFrame, t: Term, weight: float, relevance: Column, context: Context) -> Column:
    w = F.lit(float(weight))
    if t.type == "field":
        return w * num_field(df, t.field)
    if t.type == "flag":
        v = string(df, t.field)
        if t.equals is not None:
            on = v == t.equals
        else:
            text = t.field in df.columns and dict(df.dtypes)[t.field] == "string"
            on = v == "true" if text else v.isin("true", "1")
        return F.when(on, w).otherwise(0.0)
    if t.type == "set_boost":
        members = context.sets.get(t.set_key)
        return F.when(string(df, t.field).isin(list(members)), w).otherwise(0.0) if members else F.lit(0.0)
    if t.type == "recency_decay":
        if context.now is None:
            return F.lit(0.0)
        age = F.greatest(F.lit(0.0), F.lit(float(context.now)) - num_field(df, t.field))
        return w * F.pow(F.lit(2.0), -age / float(t.half_life_ms))
    if t.type == "geo_distance":
        if context.origin is None:
            return F.lit(0.0)
        km = haversine_km(*map(float, context.origin), number(df, t.lat_field), number(df, t.lng_field))
        return F.coalesce(w * F.greatest(F.lit(0.0), 1 - km / float(t.max_km)), F.lit(0.0))
    return w * relevance


def profile_score(df: DataFrame, profile: Profile, relevance: Column, weights: Mapping[str, float] | None, context: Context) -> Column:
    """Sum of the profile's terms, ``weights`` overriding by term id."""
    out = F.lit(0.0)
    for t in profile.terms:
        out = out + term_value(df, t, (weights or {}).get(t.id, t.weight), relevance, context)
    return out


def blend_score(df: DataFrame, relevance: Column, rank_by: Mapping | None) -> Column:
    """``text`` times the relevance plus weighted fields; plain relevance without ``rank_by``."""
    if not rank_by:
        return relevance
    out = F.lit(float(1 if rank_by.get("text") is None else rank_by["text"])) * relevance
    for f, w in dict(rank_by.get("fields") or {}).items():
        out = out + F.lit(float(w)) * num_field(df, f)
    return out


def order_columns(df: DataFrame, keys: tuple[SortKey, ...], text_match: Column | None = None) -> list[Column]:
    """Ordering by ``keys`` and then id; ``_text_match`` names the relevance."""
    out = []
    for k in keys:
        value = text_match if k.field == "_text_match" and text_match is not None else num_field(df, k.field)
        out.append(value.desc() if k.order == "desc" else value.asc())
    return [*out, F.col("id").asc()]
