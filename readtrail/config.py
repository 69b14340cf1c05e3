"""Constants and deployment settings shared by all jobs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# --- fixed values: results depend on them being exactly these ----------------
FIRST_DAY = dt.date(2021, 1, 1)
SPEND_FIRST_DAY = dt.date(2024, 5, 1)
SESSION_GAP_SECONDS = 120
MIN_PUZZLES = 3
READER_LEVEL = 25
GAME_COMPLETE_PERCENT = 90
MIN_APP_VERSION = "v1.0.25"
EXPORT_TIME_ZONE = "America/Los_Angeles"

STAGE_NUMBERS = {
    "session_start": 0,
    "download_completed": 1,
    "tapped_start": 2,
    "selected_level": 3,
    "puzzle_completed": 4,
    "level_completed": 5,
}

LANGUAGE_ALIASES = {
    "ukranian": "ukrainian",
    "malgache": "malagasy",
    "arabictest": "arabic",
    "farsitest": "farsi",
}

APPS = ["CR", "Unity"]

STEP_TITLES = {
    "LR": "Learner Reached",
    "DC": "Download Completed",
    "TS": "Tapped Start",
    "SL": "Selected Level",
    "PC": "Puzzle Completed",
    "LA": "Learners Acquired",
    "RA": "Readers Acquired",
    "GC": "Game Completed",
}

FUNNEL_SIZES = {
    "compact": ["LR", "PC", "LA", "RA", "GC"],
    "medium": ["DC", "TS", "SL", "PC", "LA", "RA", "GC"],
    "large": ["LR", "DC", "TS", "SL", "PC", "LA", "RA", "GC"],
}

CAMPAIGN_COUNTRY = r"-\s*(.*)"
CAMPAIGN_COUNTRY_CUT = r"\s*(.*)Campaign"
CAMPAIGN_LANGUAGE = r":\s*([^-]+?)\s*-"
URL_LANGUAGE_PARAM = "cr_lang"
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class AppProfile:
    """Host names and app ids of one deployment; the jobs hard-code none of them.

    web_host            host serving the web game, also looked for in page URLs
    standalone_suffix   what follows ``<prefix>`` in the host of a standalone build
    container_app_id    app id of the container app that launches the game
    legacy_marker       text that the app ids of the legacy apps contain
    bundled_host/label  host of the bundled build, and the app label it gets
    """

    web_host: str
    standalone_suffix: str
    container_app_id: str
    legacy_marker: str
    bundled_host: str = "appassets.androidplatform.net"
    bundled_label: str = "WBS-standalone"
