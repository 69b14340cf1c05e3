"""Column expressions that read values out of an event row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from readtrail import config
from readtrail.config import AppProfile


def _param(key: str, params: str) -> Column:
    # Positions instead of filter(): a lambda can be neither compiled nor shared between
    # lookups.  An absent key has position 0, and get() yields NULL at -1.
    place = F.array_position(F.col(f"{params}.key"), key).cast("int") - 1
    return F.get(params, place)["value"]


def param_str(key: str, params: str = "event_params") -> Column:
    """Text value of an event parameter, NULL when the event does not carry it."""
    return _param(key, params)["string_value"]


def param_int(key: str, params: str = "event_params") -> Column:
    """Integer value of an event parameter, NULL when the event does not carry it."""
    return _param(key, params)["int_value"]


def extract_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract that gives NULL, not '', when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def url_param(url: Column, name: str) -> Column:
    """Lower-cased value of a URL query parameter."""
    # a match is never empty here, so '' can only mean that there was none
    return F.lower(F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&]+)", 1), F.lit("")))


def app_suffix(app_id: Column, marker: str) -> Column:
    """Lower-cased text after the marker in an app id; '' when nothing follows it."""
    return F.lower(extract_or_null(app_id, rf"(?i)\Q{marker}\E(.*)"))


def is_standalone_host(hostname: Column, profile: AppProfile) -> Column:
    """Host of the form '<prefix><standalone suffix>', the prefix not empty."""
    suffix = profile.standalone_suffix
    return hostname.endswith(suffix) & (F.length(hostname) > len(suffix))


def label_app(hostname: Column, profile: AppProfile) -> Column:
    """App label of a host: bundled build, '<prefix>-standalone', else 'CR'."""
    prefix = F.left(hostname, F.length(hostname) - len(profile.standalone_suffix))
    return (
        F.when(hostname == profile.bundled_host, F.lit(profile.bundled_label))
        .when(is_standalone_host(hostname, profile), F.concat(prefix, F.lit("-standalone")))
        .otherwise(F.lit("CR"))
    )


def level_from_action(action: Column, lenient: bool = False) -> Column:
    """Level number in ``LevelSuccess_<n>``; text that is no number raises unless lenient."""
    tail = F.substring(action, F.instr(action, "_") + F.lit(1), F.length(action))
    return tail.try_cast("bigint") if lenient else tail.cast("bigint")


def funnel_stage(event: Column) -> Column:
    """Position of an event in the funnel, -1 for any other event."""
    stage = F.lit(-1)
    for name, number in config.STAGE_NUMBERS.items():
        stage = F.when(event == name, F.lit(number)).otherwise(stage)
    return stage


def event_of_stage(stage: Column) -> Column:
    """Inverse of :func:`funnel_stage`."""
    event = F.lit(None).cast("string")
    for name, number in config.STAGE_NUMBERS.items():
        event = F.when(stage == number, F.lit(name)).otherwise(event)
    return event


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def campaign_country(name: Column) -> Column:
    """Text after the first dash, cut before the last 'Campaign'."""
    tail = strip(extract_or_null(name, config.CAMPAIGN_COUNTRY))
    return strip(F.coalesce(extract_or_null(tail, config.CAMPAIGN_COUNTRY_CUT), tail))


def campaign_language(name: Column) -> Column:
    """Lower-cased text between ':' and '-'."""
    return F.lower(strip(extract_or_null(name, config.CAMPAIGN_LANGUAGE)))
