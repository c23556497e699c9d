"""Keyword intents of short utterances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of each intent, in order of preference.
INTENTS = {
    "baby_status_query": ["상태", "어때", "괜찮", "자고", "잘 자", "호흡", "울"],
    "humidity_control": ["건조", "습도", "가습", "촉촉"],
    "temperature_control": ["더워", "더운", "추워", "추운", "온도", "에어컨", "시원", "따뜻"],
    "light_control": ["불", "조명", "어두", "밝"],
    "air_control": ["공기", "환기", "답답", "청정"],
}

#: The action that each intent suggests.
ACTIONS = {
    "baby_status_query": "report_status",
    "humidity_control": "run_humidifier",
    "temperature_control": "adjust_temperature",
    "light_control": "adjust_light",
    "air_control": "run_air_purifier",
}


def intent_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the lower-case text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for k in keywords:
        out = out + low.contains(k).cast("int")
    return out


def classify_intent(text: Column, intents: Mapping[str, Sequence[str]] = INTENTS) -> Column:
    """A struct of intent and hits: the intent with the most keywords, of equals the first; `unknown` with 0 if none is there."""
    hits = {name: intent_hits(text, words) for name, words in intents.items()}
    most = F.greatest(F.lit(0), F.lit(0), *hits.values())
    chosen = F.when(most == 0, "unknown")
    for name, n in hits.items():
        chosen = chosen.when(n == most, name)
    return F.struct(chosen.alias("intent"), most.alias("hits"))


def intent_action(intent: Column, actions: Mapping[str, str] = ACTIONS) -> Column:
    """The suggested action; null for an unknown intent."""
    pairs = [F.lit(x) for pair in actions.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), intent)
