"""DuckDB SQL twins of the registered queries, over the driver's tables.

Written from the rules, not from the Spark plans: sessions by lag over single events,
picks by row_number, one learner per row by explicit ranking.
"""

from __future__ import annotations

import re

_HOST = "game.example.org"
_STANDALONE = "_reader-standalone.example.net"
_BUNDLED = "appassets.androidplatform.net"
_STANDALONE_RE = r"^(.+)_reader-standalone\.example\.net$"

# touch of a learner row: odd users have none, or one before the reporting window
_TOUCH = """CASE WHEN user_id % 11 = 5 THEN NULL WHEN user_id % 13 = 7 THEN DATE '2020-12-31'
            ELSE DATE '1970-01-01' + CAST({days} AS INTEGER) END"""

_CTES: dict[str, str] = {
    "src": """
      SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, epoch_us(e.ts) AS us,
             CAST(e.ts AS DATE) AS day,
             CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS k,
             (CAST(e.ts AS DATE) - DATE '1970-01-01') // 2 AS period,
             e.user_id || '-' || ((CAST(e.ts AS DATE) - DATE '1970-01-01') // 2) AS learner,
             n.n_name AS nation
      FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25""",
    "game": f"""
      SELECT us AS event_timestamp, day AS event_dt, nation AS country,
             CASE WHEN k % 9 = 0 THEN 'q' ELSE 'p' END || learner AS user_pseudo_id,
             CASE WHEN k % 41 = 0 THEN 'screen_view'
                  WHEN event_type = 'error' THEN 'session_start'
                  WHEN event_type = 'signup' THEN 'download_completed'
                  WHEN event_type = 'view' THEN 'tapped_start'
                  WHEN event_type = 'click' THEN
                       CASE WHEN k % 2 = 0 THEN 'selected_level' ELSE 'puzzle_completed' END
                  WHEN event_type = 'purchase' THEN 'level_completed' END AS event_name,
             CASE WHEN k % 37 = 0 THEN NULL WHEN k % 31 = 0 THEN '' ELSE learner END AS cr_user_id,
             CASE WHEN k % 29 = 0 THEN 'http' ELSE 'https' END || '://{_HOST}/index.html?x=1'
               || CASE WHEN k % 17 = 0 THEN '' ELSE '&cr_lang='
                  || ['English', 'French', 'Swahili', 'Zulu'][
                       1 + (user_id + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 4]
                  || '&v=2' END AS page_location,
             CASE WHEN k % 17 = 0 THEN NULL ELSE ['english', 'french', 'swahili', 'zulu'][
                  1 + (user_id + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 4] END AS app_language,
             CASE WHEN k % 43 <> 0 THEN k % 40 END AS level_raw,
             CAST(floor(value) AS BIGINT) AS puzzles,
             CASE WHEN floor(value) >= 3 THEN 'success' ELSE 'failure' END AS success_or_failure,
             CASE WHEN k % 23 = 0 THEN 'elsewhere.example.org'
                  WHEN user_id % 5 = 0 THEN '{_BUNDLED}'
                  WHEN user_id % 5 = 1 THEN 'demo{_STANDALONE}'
                  ELSE '{_HOST}' END AS hostname,
             {_TOUCH.format(days="period * 2 - user_id % 3")} AS first_open
      FROM src""",
    "ev": f"""
      SELECT user_pseudo_id, cr_user_id, first_open, country, app_language,
             level_raw + 1 AS level_number, puzzles AS number_of_successful_puzzles,
             success_or_failure, event_name,
             list_position(['session_start', 'download_completed', 'tapped_start',
               'selected_level', 'puzzle_completed', 'level_completed'], event_name) - 1 AS funnel_stage,
             event_dt, hostname, event_timestamp,
             event_name = 'level_completed' AND puzzles >= 3 AND level_raw IS NOT NULL AS good
      FROM game
      WHERE event_name IN ('session_start', 'download_completed', 'tapped_start',
              'selected_level', 'puzzle_completed', 'level_completed')
        AND cr_user_id <> ''
        AND (hostname = '{_BUNDLED}' OR regexp_matches(hostname, '{_STANDALONE_RE}')
             OR (starts_with(hostname, '{_HOST}') AND contains(page_location, 'https://{_HOST}')))
        AND COALESCE(first_open, event_dt) BETWEEN DATE '2021-01-01' AND DATE '2024-01-28'""",
    "langs": """
      SELECT * FROM (VALUES ('english', 40, 'English'), ('english', 40, 'English (South Africa)'),
        ('french', 38, 'French'), ('swahili', 36, 'Swahili'), ('zulu', 0, 'Zulu'), ('', 20, 'Other'))
        AS t(app_language, max_level, display_language)""",
    "lev": f"""
      SELECT us AS event_timestamp, nation AS country,
             learner || CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END AS lrn, k,
             CASE WHEN k < 20 THEN ['english', 'french', 'swahili', NULL][1 + k % 4]
                  ELSE ['english', 'french', 'swahili', 'zulu'][1 + user_id % 4] END AS app_language,
             {_TOUCH.format(days="period * 2 - user_id % 3 - 1")} AS first_open
      FROM src
      WHERE event_type IN ('signup', 'view') AND k % 13 <> 0 AND k % 19 <> 0 AND k % 27 <> 0
        AND k % 37 <> 0""",
    "launch_ev": """
      SELECT CASE WHEN k % 31 = 0 THEN '' ELSE lrn END AS cr_user_id, 'p' || lrn AS user_pseudo_id,
             country, app_language, first_open, event_timestamp
      FROM lev WHERE first_open BETWEEN DATE '2021-01-01' AND DATE '2024-01-28'""",
    "members": """
      SELECT DISTINCT s.learner AS cr_user_id, c.c_mktsegment AS cohort_name
      FROM src s JOIN customer c ON c.c_custkey = s.user_id WHERE s.user_id % 4 = 0
      UNION ALL
      SELECT DISTINCT learner, 'pilot' FROM src WHERE user_id % 6 = 0""",
    "launch": """
      SELECT l.*, m.cohort_name FROM (
        SELECT cr_user_id, user_pseudo_id, country, app_language, first_open,
               make_timestamp(min(event_timestamp)) AS first_launch_ts
        FROM launch_ev GROUP BY ALL) l LEFT JOIN members m USING (cr_user_id)""",
    "old": f"""
      SELECT event_id, us AS event_timestamp, day AS event_dt, k, user_id % 3 AS source,
             'u' || user_id || '-' || (day(day) // 3) AS user_pseudo_id,
             CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'user_engagement'
                  ELSE 'GamePlay' END AS event_name,
             CASE event_type
                  WHEN 'purchase' THEN 'LevelSuccess_' || CASE WHEN user_id % 3 = 0
                       THEN k % 30 + 1 ELSE k % 4 + 1 END
                  WHEN 'click' THEN 'SegmentSuccess_' || k WHEN 'error' THEN 'Quit' END AS action,
             'NATION_' || ((user_id + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) % 25) AS country,
             CASE WHEN user_id % 17 <> 3 THEN
                  ['english', 'french', 'swahili', ''][1 + user_id % 4] END AS app_language,
             '1.' || (k % 5) AS app_version,
             {_TOUCH.format(days="(day - DATE '1970-01-01') - user_id % 3")} AS first_open
      FROM src""",
    "old_params": """
      SELECT *, 'action' AS param_key, action AS param_text FROM old WHERE action IS NOT NULL
      UNION ALL
      SELECT *, 'screen', 'main' FROM old WHERE action IS NULL AND k % 19 <> 0
      UNION ALL
      SELECT *, 'engagement_ms', NULL FROM old WHERE action IS NULL AND k % 19 <> 0""",
    "old_ev": """
      SELECT user_pseudo_id, event_name, first_open, country, app_language, app_version, event_dt,
             event_timestamp,
             CASE WHEN starts_with(param_text, 'LevelSuccess') THEN event_dt END AS level_success_date,
             CASE WHEN starts_with(param_text, 'LevelSuccess')
                  THEN CAST(split_part(param_text, '_', 2) AS BIGINT) END AS user_level,
             CASE WHEN param_text = 'LevelSuccess_25' THEN event_dt END AS reader_date,
             CASE WHEN starts_with(param_text, 'LevelSuccess') THEN 1 ELSE 0 END AS level_completed_flag,
             CASE WHEN starts_with(param_text, 'SegmentSuccess') THEN 1 ELSE 0 END AS puzzle_completed_flag,
             CASE WHEN event_name = 'session_start' THEN 1 ELSE 0 END AS session_start_flag
      FROM old_params
      WHERE param_text IS DISTINCT FROM 'Quit' AND app_language IS NOT NULL
        AND first_open BETWEEN DATE '2021-01-01' AND DATE '2024-01-28'""",
    # --- learner tables
    "ev_sessions": """
      SELECT cr_user_id, sid, count(*) AS n, (max(us) - min(us)) // 1000000 AS secs
      FROM (SELECT cr_user_id, us, sum(fresh) OVER (PARTITION BY cr_user_id ORDER BY us) AS sid
            FROM (SELECT cr_user_id, event_timestamp AS us,
                         CASE WHEN (event_timestamp - lag(event_timestamp) OVER w) // 1000000 <= 120
                              THEN 0 ELSE 1 END AS fresh
                  FROM ev WINDOW w AS (PARTITION BY cr_user_id ORDER BY event_timestamp)))
      GROUP BY ALL""",
    "ev_stats": """
      SELECT cr_user_id, count(*) AS session_count, CAST(sum(n) AS BIGINT) AS engagement_event_count,
             round(sum(secs) / 60.0::DOUBLE, 1) AS total_time_minutes,
             round(avg(secs) / 60.0::DOUBLE, 1) AS avg_session_length_minutes
      FROM ev_sessions GROUP BY cr_user_id""",
    "marks": """
      SELECT cr_user_id, country, app_language,
             min(event_dt) FILTER (good) AS la_date,
             COALESCE(min(event_dt) FILTER (good AND level_number = 25),
                      min(event_dt) FILTER (good AND level_number >= 26)) AS ra_date,
             COALESCE(max(level_number) FILTER (good), 0) AS max_user_level
      FROM ev GROUP BY ALL""",
    "firsts": """
      SELECT cr_user_id, country, app_language, user_pseudo_id, hostname
      FROM ev
      QUALIFY row_number() OVER (PARTITION BY cr_user_id, country, app_language
                                 ORDER BY event_dt, event_timestamp) = 1""",
    "progress": f"""
      SELECT f.user_pseudo_id, g.cr_user_id, g.first_open, g.first_event_date, g.country,
             g.app_language,
             CASE WHEN f.hostname = '{_BUNDLED}' THEN 'WBS-standalone'
                  WHEN regexp_matches(f.hostname, '{_STANDALONE_RE}')
                  THEN regexp_extract(f.hostname, '{_STANDALONE_RE}', 1) || '-standalone'
                  ELSE 'CR' END AS app,
             m.max_user_level, CAST(l.longest AS BIGINT) AS max_game_level, m.la_date, m.ra_date,
             CAST(m.ra_date - g.start_day + 1 AS INTEGER) AS days_to_ra,
             ['session_start', 'download_completed', 'tapped_start', 'selected_level',
              'puzzle_completed', 'level_completed'][g.stage + 1] AS furthest_event,
             m.max_user_level / NULLIF(l.longest, 0)::DOUBLE * 100 AS gpc,
             s.session_count, s.engagement_event_count, s.total_time_minutes,
             s.avg_session_length_minutes, e.last_event_date,
             CAST(e.last_event_date - g.start_day AS INTEGER) AS active_span,
             CAST(g.stage >= 4 AS INTEGER) AS pc_flag,
             CAST(m.max_user_level >= 1 AS INTEGER) AS la_flag,
             CAST(m.max_user_level >= 25 AS INTEGER) AS ra_flag,
             CASE WHEN m.max_user_level >= 1
                   AND m.max_user_level / NULLIF(l.longest, 0)::DOUBLE * 100 >= 90
                  THEN 1 ELSE 0 END AS gc_flag,
             1 AS lr_flag
      FROM (SELECT cr_user_id, country, app_language, min(first_open) AS first_open,
                   min(event_dt) AS first_event_date, max(funnel_stage) AS stage,
                   CASE WHEN min(first_open) IS NOT NULL
                        THEN least(min(first_open), min(event_dt)) END AS start_day
            FROM ev GROUP BY cr_user_id, country, app_language) g
      JOIN marks m ON m.cr_user_id = g.cr_user_id AND m.country = g.country
        AND m.app_language IS NOT DISTINCT FROM g.app_language
      JOIN firsts f ON f.cr_user_id = g.cr_user_id AND f.country = g.country
        AND f.app_language IS NOT DISTINCT FROM g.app_language
      LEFT JOIN (SELECT app_language, max(max_level) AS longest FROM langs GROUP BY 1) l
        ON l.app_language = g.app_language
      LEFT JOIN (SELECT cr_user_id, max(event_dt) AS last_event_date FROM ev GROUP BY 1) e
        ON e.cr_user_id = g.cr_user_id
      LEFT JOIN ev_stats s ON s.cr_user_id = g.cr_user_id""",
    "old_stats": """
      SELECT user_pseudo_id, count(*) AS n_sessions, round(sum(secs) / 60.0::DOUBLE, 1) AS total_min,
             round(avg(secs) / 60.0::DOUBLE, 1) AS avg_min
      FROM (SELECT user_pseudo_id, sid, (max(us) - min(us)) // 1000000 AS secs
            FROM (SELECT user_pseudo_id, us,
                         sum(fresh) OVER (PARTITION BY user_pseudo_id ORDER BY rn) AS sid
                  FROM (SELECT user_pseudo_id, event_timestamp AS us,
                               row_number() OVER w AS rn,
                               CASE WHEN (event_timestamp - lag(event_timestamp) OVER w) // 1000000
                                         <= 120 THEN 0 ELSE 1 END AS fresh
                        FROM old_ev
                        WINDOW w AS (PARTITION BY user_pseudo_id ORDER BY event_timestamp)))
            GROUP BY ALL)
      GROUP BY 1""",
    "skips": """
      SELECT user_pseudo_id, max(user_level) AS max_played_level,
             len(list_filter(range(1, max(user_level) + 1),
                 lambda x: NOT list_contains(list(DISTINCT user_level), x))) > 0 AS skipped_level
      FROM old_ev WHERE user_level IS NOT NULL GROUP BY 1""",
    "old_progress": """
      SELECT a.*, CAST(a.ra_date - a.first_open AS INTEGER) AS days_to_ra,
             CAST(greatest(a.last_event_date - a.first_event_date, 1) AS INTEGER) AS active_span,
             s.n_sessions AS engagement_event_count, s.total_min AS total_time_minutes,
             s.avg_min AS avg_session_length_minutes,
             a.max_user_level / NULLIF(a.max_game_level, 0)::DOUBLE * 100 AS gpc,
             CAST(a.max_user_level >= 1 AS INTEGER) AS la_flag,
             CAST(a.max_user_level >= 25 AS INTEGER) AS ra_flag,
             CASE WHEN a.max_user_level >= 1
                   AND a.max_user_level / NULLIF(a.max_game_level, 0)::DOUBLE * 100 >= 90
                  THEN 1 ELSE 0 END AS gc_flag,
             1 AS lr_flag, COALESCE(k.skipped_level, false) AS skipped_level
      FROM (SELECT o.user_pseudo_id, min(first_open) AS first_open, max(country) AS country,
                   max(o.app_language) AS app_language,
                   COALESCE(max(user_level), 0) AS max_user_level,
                   CAST(max(d.max_level) AS BIGINT) AS max_game_level,
                   max(app_version) AS app_version, min(level_success_date) AS la_date,
                   CAST(NULL AS BIGINT) AS started_in_offline_mode, 'Unity' AS app,
                   min(reader_date) AS ra_date, min(event_dt) AS first_event_date,
                   max(event_dt) AS last_event_date,
                   CAST(sum(level_completed_flag) AS BIGINT) AS level_completed_count,
                   CAST(sum(session_start_flag) AS BIGINT) AS total_sessions,
                   CASE WHEN sum(level_completed_flag) > 0 THEN 'level_completed'
                        WHEN sum(puzzle_completed_flag) > 0 THEN 'puzzle_completed'
                        WHEN sum(session_start_flag) > 0 THEN 'session_start' END AS furthest_event
            FROM old_ev o
            LEFT JOIN (SELECT DISTINCT app_language, max_level FROM langs) d
              ON d.app_language = o.app_language
            GROUP BY 1) a
      LEFT JOIN old_stats s USING (user_pseudo_id) LEFT JOIN skips k USING (user_pseudo_id)""",
    # --- cleaning
    "best": """
      SELECT * REPLACE (COALESCE(furthest_event, 'unknown') AS furthest_event) FROM progress
      QUALIFY row_number() OVER (PARTITION BY cr_user_id ORDER BY
        furthest_event IS NOT DISTINCT FROM 'level_completed' DESC, max_user_level DESC NULLS LAST,
        NULLIF(list_position(['download_completed', 'tapped_start', 'selected_level',
          'puzzle_completed', 'level_completed'], furthest_event), 0) DESC NULLS LAST,
        engagement_event_count DESC NULLS LAST, country NULLS LAST, app_language NULLS LAST) = 1""",
    "marked": """
      SELECT *, count(*) OVER (PARTITION BY user_pseudo_id) > 1 AS dup,
             row_number() OVER (ORDER BY first_open DESC NULLS LAST, first_launch_ts NULLS LAST,
               country NULLS LAST, app_language NULLS LAST, user_pseudo_id NULLS LAST,
               cr_user_id, cohort_name NULLS FIRST) AS pos
      FROM launch""",
    "kept": """
      SELECT m.* EXCLUDE (app_language), CASE WHEN b.cr_user_id IS NULL THEN m.app_language
               ELSE b.app_language END AS app_language
      FROM marked m LEFT JOIN best b ON b.cr_user_id = m.cr_user_id
      WHERE m.cr_user_id NOT IN (SELECT cr_user_id FROM marked WHERE dup)""",
    "added": """
      SELECT *, 1 AS turn FROM marked WHERE dup AND app_language IS NOT NULL
      UNION ALL
      SELECT *, 2 AS turn FROM marked
      WHERE dup AND cr_user_id NOT IN (SELECT cr_user_id FROM best)""",
    "clean_launch": """
      SELECT cr_user_id, user_pseudo_id, country, app_language, first_open, first_launch_ts, cohort_name
      FROM (SELECT cr_user_id, user_pseudo_id, country, app_language, first_open, first_launch_ts,
                   cohort_name, pos, 0 AS turn FROM kept
            UNION ALL
            SELECT cr_user_id, user_pseudo_id, country, app_language, first_open, first_launch_ts,
                   cohort_name, pos, turn FROM added)
      QUALIFY row_number() OVER (PARTITION BY cr_user_id ORDER BY turn, pos) = 1""",
    "clean_users": """
      SELECT b.* REPLACE (CASE WHEN b.app = 'CR' THEN c.first_open ELSE b.first_open END AS first_open)
      FROM best b LEFT JOIN clean_launch c ON c.cr_user_id = b.cr_user_id""",
    # --- cohorts: one date range, listed languages with NULL among them
    "co": """
      SELECT *, CASE WHEN max_user_level >= 1 THEN gpc END AS la_gpc FROM clean_users
      WHERE app = 'CR' AND first_open BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'
        AND COALESCE(app_language, 'zulu') IN ('english', 'french', 'swahili', 'zulu')""",
    "co_lr": """
      SELECT * FROM clean_launch
      WHERE first_open BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'
        AND COALESCE(app_language, 'zulu') IN ('english', 'french', 'swahili', 'zulu')""",
    "co_unity": """
      SELECT * FROM old_progress
      WHERE first_open BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'
        AND COALESCE(app_language, 'zulu') IN ('english', 'french', 'swahili', 'zulu')""",
    "co_wbs": """
      SELECT * FROM clean_users
      WHERE app = 'WBS-standalone' AND first_open BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'
        AND COALESCE(app_language, 'zulu') IN ('english', 'french', 'swahili', 'zulu')""",
    "co_all": """
      SELECT cr_user_id, country, app_language, furthest_event, max_user_level, gpc FROM co
      UNION ALL
      SELECT NULL, country, app_language, furthest_event, max_user_level, gpc FROM co_unity""",
    # --- options
    "co_any": """
      SELECT COALESCE(cr_user_id, user_pseudo_id) AS any_id, country, app_language, furthest_event,
             max_user_level, gpc FROM co
      UNION ALL
      SELECT user_pseudo_id, country, app_language, furthest_event, max_user_level, gpc FROM co_unity""",
    "added_strict": """
      SELECT m.*, 1 AS turn FROM marked m
      WHERE dup AND EXISTS (SELECT 1 FROM best b WHERE b.cr_user_id = m.cr_user_id
        AND b.app_language = m.app_language AND b.country IS NOT DISTINCT FROM m.country)
      UNION ALL
      SELECT * FROM added WHERE turn = 2""",
    # --- advertising
    "ord": """
      SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey % 50 AS c,
             CAST(o_orderdate AS DATE) + 9617 AS day,
             CASE WHEN o_custkey % 10 = 0 THEN 'Brand awareness'
                  WHEN o_custkey % 10 = 5 THEN 'Ads: general'
                  ELSE 'Ads: ' || ['English', 'French', 'Swahili', 'Zulu'][1 + (o_custkey % 50) % 4]
                       || ' - NATION_' || (o_custkey % 50) % 25
                       || CASE WHEN (o_custkey % 50) % 3 = 0 THEN ' Campaign' ELSE '' END
             END AS name
      FROM orders""",
    "goog": """
      SELECT DISTINCT CAST(s.c AS VARCHAR) AS campaign_id, s.day AS segment_date,
             g.name AS campaign_name,
             round_even(round(s.o_totalprice * 1000000) / 1000000::DOUBLE * 100, 0) / 100::DOUBLE AS cost,
             g.first_day AS campaign_start_date,
             CASE WHEN s.c % 7 <> 0 THEN g.last_day END AS campaign_end_date, 'Google' AS source
      FROM ord s JOIN (SELECT c, min(name) AS name, min(day) AS first_day, max(day) AS last_day
                       FROM ord GROUP BY c) g ON g.c = s.c
      WHERE s.o_orderstatus <> 'F' AND s.day >= DATE '2024-05-01'""",
    "fb": """
      SELECT CAST(c + 1000 AS VARCHAR) AS campaign_id, day AS segment_date,
             CASE WHEN c % 4 = 1 AND day >= DATE '2026-01-01'
                  THEN 'FB: Zulu - NATION_3 Campaign 2' ELSE name END AS campaign_name,
             o_totalprice AS cost, CASE WHEN o_orderkey % 5 <> 0 THEN day END AS campaign_start_date,
             CAST(NULL AS DATE) AS campaign_end_date, 'Facebook' AS source
      FROM ord WHERE o_orderstatus = 'F' AND day >= DATE '2024-05-01'""",
    "camp": r"""
      SELECT *,
        CASE WHEN regexp_matches(campaign_name, '-\s*(.*)') THEN
          CASE WHEN contains(split_after, 'Campaign')
               THEN trim(regexp_extract(split_after, '^(.*)Campaign', 1))
               ELSE split_after END END AS country,
        CASE WHEN regexp_matches(campaign_name, ':\s*([^-]+?)\s*-')
             THEN lower(trim(regexp_extract(campaign_name, ':\s*([^-]+?)\s*-', 1))) END AS app_language
      FROM (SELECT *, trim(substr(campaign_name, strpos(campaign_name, '-') + 1)) AS split_after
            FROM (SELECT * FROM goog UNION ALL SELECT * FROM fb))""",
}

_CTES["clean_launch_strict"] = re.sub(r"\badded\b", "added_strict", _CTES["clean_launch"])
# legacy events counted once each, instead of once for every parameter
_ONCE = ["old_params", "old_ev", "old_stats", "skips", "old_progress"]
for _name in _ONCE:
    _CTES[f"{_name}_once"] = re.sub(rf"\b({'|'.join(_ONCE)})\b", r"\1_once", _CTES[_name])
_CTES["old_params_once"] = """
      SELECT *, 'action' AS param_key, action AS param_text FROM old WHERE action IS NOT NULL
      UNION ALL
      SELECT *, NULL, NULL FROM old WHERE action IS NULL"""

_ROLL_COLUMNS = [
    "campaign_name", "campaign_start_date", "campaign_end_date", "source", "country", "app_language",
]


def _newest(column: str) -> str:
    return (
        f"list({column} ORDER BY segment_date DESC, campaign_name DESC, {column} DESC) "
        f"FILTER ({column} IS NOT NULL)[1] AS {column}"
    )


def _rolled(where: str = "true") -> str:
    picks = ", ".join(_newest(c) for c in _ROLL_COLUMNS)
    return (
        f"SELECT campaign_id, round(sum(cost), 2) AS cost, {picks} FROM camp "
        f"WHERE {where} GROUP BY campaign_id"
    )


_AFTER = {
    "DC": "furthest_event IN ('download_completed', 'tapped_start', 'selected_level', "
          "'puzzle_completed', 'level_completed')",
    "TS": "furthest_event IN ('tapped_start', 'selected_level', 'puzzle_completed', 'level_completed')",
    "SL": "furthest_event IN ('selected_level', 'puzzle_completed', 'level_completed')",
    "PC": "furthest_event IN ('puzzle_completed', 'level_completed')",
    "LA": "max_user_level >= 1",
    "RA": "max_user_level >= 25",
    "GC": "max_user_level >= 1 AND gpc >= 90",
}
_SHORT = ["PC", "LA", "RA", "GC"]
_LONG = ["DC", "TS", "SL", *_SHORT]


def _counts(steps: list[str]) -> str:
    return ", ".join(f"count(*) FILTER ({_AFTER[s]}) AS {s}" for s in steps)


def _funnel(users: str, by: str, steps: list[str], key: str, reached: str | None = None,
            round_gpp: bool = True) -> str:
    gpp = "CASE WHEN LA > 0 THEN COALESCE(mean_gpc, 0.0) END"
    if round_gpp:
        gpp = f"round({gpp}, 6)"
    gca = ("CASE WHEN LA > 0 THEN "
           "round_even(done / NULLIF(acquired, 0)::DOUBLE * 100 * 100, 0) / 100::DOUBLE END")
    share = ", ".join(f"{s} / NULLIF(LR, 0)::DOUBLE * 100 AS {s}_pct" for s in steps)
    lr = f"""(SELECT count(DISTINCT r.{key}) FROM {reached} r WHERE r.{by} = u.{by})""" if reached \
        else f"count(DISTINCT u.{key})"
    return f"""
      SELECT {by}, LR, {", ".join(steps)}, 100.0::DOUBLE AS LR_pct, {share}, {gpp} AS GPP,
             {gpp} AS GPP_pct, {gca} AS GCA, {gca} AS GCA_pct
      FROM (SELECT {by}, {lr} AS LR, {_counts(steps)},
                   avg(gpc) FILTER (max_user_level >= 1) AS mean_gpc,
                   count(DISTINCT {key}) FILTER (max_user_level >= 1) AS acquired,
                   count(DISTINCT {key}) FILTER (max_user_level >= 1 AND gpc >= 90) AS done
            FROM {users} u WHERE {by} IS NOT NULL GROUP BY {by})
      WHERE {" + ".join(steps)} > 0"""


def _app_row(app: str, users: str, steps: list[str], key: str, reached: str | None = None) -> str:
    lr = f"(SELECT count(DISTINCT {key}) FROM {reached})" if reached else f"count(DISTINCT {key})"
    la = "count(*) FILTER (max_user_level >= 1)"
    return f"""
      SELECT '{app}' AS app, {lr} AS LR, {_counts(steps)},
             CASE WHEN {la} > 0 THEN avg(gpc) FILTER (max_user_level >= 1) ELSE 0.0 END AS GPP,
             CASE WHEN {la} > 0 THEN count(*) FILTER (max_user_level >= 1 AND gpc >= 90)
                  / ({la})::DOUBLE * 100 ELSE 0.0 END AS GCA
      FROM {users}"""


_TWO_APPS = (
    _app_row("CR", "co", _SHORT, "cr_user_id", "co_lr") + " UNION ALL "
    + _app_row("Unity", "co_unity", _SHORT, "user_pseudo_id")
)
_THREE_APPS = " UNION ALL ".join([
    _app_row("CR", "co", _LONG, "cr_user_id", "co_lr"),
    _app_row("Unity", "co_unity", _LONG, "user_pseudo_id"),
    _app_row("WBS-standalone", "co_wbs", _LONG, "cr_user_id"),
])
_WEIGHTED = """
  CAST(sum(LR) AS BIGINT) AS LR, CAST(sum(LA) AS BIGINT) AS LA, CAST(sum(RA) AS BIGINT) AS RA,
  CAST(sum(GC) AS BIGINT) AS GC, round(sum(GPP * LR) / sum(LR), 6) AS GPP,
  round(sum(GCA * LR) / sum(LR), 6) AS GCA"""

_TITLES = {
    "LR": "Learner Reached", "DC": "Download Completed", "TS": "Tapped Start",
    "SL": "Selected Level", "PC": "Puzzle Completed", "LA": "Learners Acquired",
    "RA": "Readers Acquired", "GC": "Game Completed",
}


def _steps(totals: str, stats: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i + 1} AS pos, '{s}' AS step, '{_TITLES[s]}' AS title, CAST({s} AS BIGINT) AS n FROM t"
        for i, s in enumerate(stats)
    )
    part = "round_even(100 * n / NULLIF({}, 0)::DOUBLE * 10, 0) / 10::DOUBLE"
    before = part.format("lag(n) OVER (ORDER BY pos)")
    second = part.format("max(n) FILTER (pos = 2) OVER ()")
    return f"""
      SELECT pos, step, title, n, {before} AS percent_of_previous,
             CASE WHEN pos > 2 THEN {second} END AS percent_of_second
      FROM (WITH t AS ({totals}) {rows})"""


_STREAM = "SELECT event_id, user_id, epoch_us(ts) AS us FROM events"


def _sessions(gap: int) -> str:
    return f"""
      SELECT event_id, user_id, us, prev, secs, fresh,
             CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS session_id
      FROM (SELECT *, CASE WHEN secs <= {gap} THEN 0 ELSE 1 END AS fresh
            FROM (SELECT *, (us - prev) // 1000000 AS secs
                  FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev
                        FROM ({_STREAM}))))"""


_DURATIONS = f"""
  SELECT user_id, session_id, count(*) AS n_events, (max(us) - min(us)) // 1000000 AS session_duration_sec
  FROM ({_sessions(3600)}) GROUP BY ALL"""

_PRESETS = [
    ("All time", "2021-01-01", "2024-01-28"), ("Select year", "2024-01-01", "2024-01-28"),
    ("Select month", "2023-12-01", "2023-12-31"), ("Select month", "2024-01-01", "2024-01-28"),
    ("Select custom range", "2024-01-03", "2024-01-26"), ("Last 7 days", "2024-01-21", "2024-01-28"),
    ("Last 14 days", "2024-01-14", "2024-01-28"), ("Last 30 days", "2023-12-29", "2024-01-28"),
    ("Last 90 days", "2023-10-30", "2024-01-28"),
]

_CR_FUNNEL = _funnel("co", "country", _LONG, "cr_user_id", "co_lr")
_CR_MAP = _funnel("co", "country", _SHORT, "cr_user_id", "co_lr")
_CR_LANGUAGE = _funnel("co", "app_language", _LONG, "cr_user_id", "co_lr", round_gpp=False)

_SEGMENT_COHORT = "first_open BETWEEN DATE '2021-01-01' AND DATE '2027-12-31'"


def _each(step: str) -> str:
    return (f"{step}, CASE WHEN {step} = 0 THEN 0.0 ELSE "
            f"round_even(cost / {step} * 100, 0) / 100::DOUBLE END AS {step}C")


def _conversion(step: str) -> str:
    return (f"CASE WHEN LR = 0 THEN 0.0 ELSE "
            f"round_even({step} / LR::DOUBLE * 100, 0) / 100::DOUBLE * 100 END AS \"{step}_LR %\"")


_STATS = f"""
      SELECT user_id, count(*) AS session_count, CAST(sum(n_events) AS BIGINT) AS engagement_event_count,
             round(sum(session_duration_sec) / 60.0::DOUBLE, 1) AS total_time_minutes,
             round(avg(session_duration_sec) / 60.0::DOUBLE, 1) AS avg_session_length_minutes
      FROM ({_DURATIONS}) GROUP BY 1"""

_QUERIES: dict[str, str] = {
    "event_scan": """
      SELECT strftime(event_dt, '%Y%m%d') AS event_date, event_name, count(*) AS n,
             min(event_timestamp) AS first_us, max(event_timestamp) AS last_us
      FROM game WHERE event_dt BETWEEN DATE '2024-01-03' AND DATE '2024-01-26' GROUP BY 1, 2""",
    "union_sources": """
      SELECT user_pseudo_id, event_name, count(*) AS n, max(event_timestamp) AS last_us
      FROM old GROUP BY 1, 2""",
    "latest_run_scan": """
      SELECT cr_user_id, max(event_dt) AS last_event_date, 'newest' AS run FROM ev GROUP BY 1""",
    "language_list": "SELECT DISTINCT upper(lang) AS display_language FROM documents",
    "country_list": "SELECT country FROM old_progress UNION SELECT country FROM progress",
    "app_versions": """
      SELECT 'All' AS app_version UNION ALL
      SELECT DISTINCT 'v1.0.' || k FROM src WHERE 'v1.0.' || k >= 'v1.0.25'""",
    "google_spend": "SELECT * FROM goog",
    "facebook_spend": "SELECT * FROM fb",
    "event_params": """
      SELECT event_timestamp, cr_user_id, page_location, level_raw AS level_number, puzzles,
             success_or_failure, CAST(NULL AS VARCHAR) AS absent FROM game""",
    "cr_event_filter": "SELECT * EXCLUDE (good) FROM ev",
    "launch_filter": "SELECT * FROM launch_ev",
    "unity_event_filter": "SELECT * FROM old_ev",
    "app_label": f"""
      SELECT event_timestamp, CASE WHEN hostname = '{_BUNDLED}' THEN 'WBS-standalone'
        WHEN regexp_matches(hostname, '{_STANDALONE_RE}') THEN 'demo-standalone' ELSE 'CR' END AS app
      FROM game""",
    "url_language": """
      SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=([^&]+)')
        THEN lower(regexp_extract(url, '[?&]page=([^&]+)', 1)) END AS page FROM pages""",
    "suffix_language": "SELECT event_timestamp, app_language FROM old",
    "action_level": """
      SELECT event_timestamp, CAST(replace(action, 'LevelSuccess_', '') AS BIGINT) AS user_level
      FROM old WHERE starts_with(action, 'LevelSuccess')""",
    "funnel_stage": """
      SELECT event_timestamp, CASE WHEN event_name = 'screen_view' THEN NULL ELSE event_name END AS event,
             COALESCE(map {'session_start': 0, 'download_completed': 1, 'tapped_start': 2,
               'selected_level': 3, 'puzzle_completed': 4, 'level_completed': 5}[event_name], -1) AS stage
      FROM game""",
    "milestone_flags": """
      SELECT cr_user_id, country, app_language, pc_flag, la_flag, ra_flag, gc_flag, lr_flag
      FROM progress""",
    "game_progress": "SELECT cr_user_id, country, app_language, gpc FROM progress",
    "days_to_ra": "SELECT cr_user_id, country, app_language, days_to_ra FROM progress",
    "active_span": """
      SELECT cr_user_id, country, app_language, active_span,
             CASE WHEN active_span < 0 THEN 0 ELSE active_span END AS clipped_span FROM progress""",
    "language_alias": """
      SELECT event_id, ['ukrainian', 'malagasy', 'arabic', 'farsi', 'english', NULL][1 + k % 6]
             AS app_language FROM src""",
    "date_coerce": """
      SELECT event_id, TRY_CAST(CASE WHEN k % 10 = 9 THEN 'no date' ELSE '2024-'
        || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 35 AS VARCHAR), 2, '0') END
        AS DATE) AS first_open FROM src""",
    "cohort_filter": """
      SELECT source, cr_user_id, country, app_language, first_open FROM (
        SELECT 'progress' AS source, cr_user_id, country, app_language, first_open FROM clean_users
        WHERE app = 'CR'
        UNION ALL
        SELECT 'launches', cr_user_id, country, app_language, first_open FROM clean_launch)
      WHERE first_open BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'
        AND app_language IN ('english', 'zulu')
        AND country IN ('NATION_1', 'NATION_3', 'NATION_7', 'NATION_11')""",
    "date_presets": " UNION ALL ".join(
        f"SELECT {i} AS pos, '{o}' AS option, DATE '{a}' AS first_day, DATE '{b}' AS last_day, "
        f"count(*) FILTER (first_open BETWEEN DATE '{a}' AND DATE '{b}') AS learners FROM old_progress"
        for i, (o, a, b) in enumerate(_PRESETS)
    ),
    "campaign_names": """
      SELECT DISTINCT campaign_name, country, app_language FROM camp WHERE source = 'Facebook'
      UNION
      SELECT DISTINCT CASE WHEN c % 4 = 1 AND day >= DATE '2026-01-01'
               THEN 'FB: Zulu - NATION_3 Campaign 2' ELSE name END,
             CASE WHEN c % 4 = 1 AND day >= DATE '2026-01-01' THEN 'NATION_3'
                  WHEN c % 5 <> 0 THEN 'NATION_' || c % 25 END,
             CASE WHEN c % 4 = 1 AND day >= DATE '2026-01-01' THEN 'zulu'
                  WHEN c % 5 <> 0 THEN ['english', 'french', 'swahili', 'zulu'][1 + c % 4] END
      FROM ord WHERE o_orderstatus = 'F'""",
    "join_max_level": """
      SELECT e.cr_user_id, e.app_language, e.event_name, e.event_timestamp,
             CAST(l.max_level AS BIGINT) AS max_game_level
      FROM ev e LEFT JOIN langs l ON l.app_language = e.app_language""",
    "join_dedup_dim": """
      SELECT o.user_pseudo_id, o.app_language, o.event_name, o.event_timestamp,
             CAST(l.max_level AS BIGINT) AS max_game_level
      FROM old_ev o LEFT JOIN (SELECT DISTINCT app_language, max_level FROM langs) l
        ON l.app_language = o.app_language""",
    "join_cohorts": """
      SELECT e.cr_user_id, e.event_timestamp, m.cohort_name
      FROM launch_ev e LEFT JOIN members m ON m.cr_user_id = e.cr_user_id""",
    "unnest_params": """
      SELECT user_pseudo_id, event_name, event_timestamp, param_key, param_text FROM old_params""",
    "semi_join": """
      SELECT cr_user_id, user_pseudo_id, app_language FROM launch
      WHERE cr_user_id IN (SELECT cr_user_id FROM progress)""",
    "anti_join": """
      SELECT cr_user_id, user_pseudo_id, app_language FROM launch
      WHERE cr_user_id NOT IN (SELECT cr_user_id FROM progress)""",
    "keyed_update": """
      SELECT l.cr_user_id, l.user_pseudo_id, l.country, l.first_open,
             CASE WHEN u.cr_user_id IS NULL THEN l.app_language ELSE u.app_language END AS app_language
      FROM launch l LEFT JOIN clean_users u ON u.cr_user_id = l.cr_user_id""",
    "cr_user_progress": "SELECT * FROM progress",
    "unity_user_progress": "SELECT * FROM old_progress",
    "cr_user_progress_incremental": "SELECT * FROM progress",
    "unity_user_progress_incremental": "SELECT * FROM old_progress",
    "session_stats_incremental": _STATS,
    "app_launch": "SELECT * FROM launch",
    "milestone_dates": "SELECT * FROM marks",
    "event_counts": """
      SELECT cr_user_id, country, app_language, count(*) FILTER (good) AS level_completed_count,
             count(*) FILTER (event_name = 'puzzle_completed') AS puzzle_completed_count,
             count(*) FILTER (event_name = 'selected_level') AS selected_level_count,
             count(*) FILTER (event_name = 'tapped_start') AS tapped_start_count,
             count(*) FILTER (event_name = 'download_completed') AS download_completed_count
      FROM ev GROUP BY ALL""",
    "first_by_order": """
      SELECT app_language, country, user_pseudo_id, hostname FROM ev
      QUALIFY row_number() OVER (PARTITION BY app_language, country
                                 ORDER BY event_dt, event_timestamp) = 1""",
    "furthest_event": """
      SELECT cr_user_id, country, app_language, max(funnel_stage) AS furthest_stage,
             arg_max(event_name, funnel_stage) AS furthest_event FROM ev GROUP BY ALL""",
    "last_event": "SELECT cr_user_id, max(event_dt) AS last_event_date FROM ev GROUP BY 1",
    "level_skips": "SELECT * FROM skips",
    "event_sequence": f"""
      SELECT event_id, user_id, us AS event_timestamp,
             row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ({_STREAM})""",
    "event_sequence_ties": f"""
      SELECT event_id, user_id, us AS event_timestamp, row_number() OVER w AS rn, lag(us) OVER w AS prev_us
      FROM (SELECT event_id, user_id,
                   CASE WHEN event_id % 17 <> 0 THEN epoch_us(date_trunc('day', make_timestamp(us))) END AS us
            FROM ({_STREAM}))
      WINDOW w AS (PARTITION BY user_id ORDER BY us NULLS FIRST, event_id)""",
    "event_deltas": f"""
      SELECT event_id, user_id, us AS event_timestamp, prev AS prev_us, secs AS seconds_since_last
      FROM ({_sessions(120)})""",
    "sessionize": f"""
      SELECT event_id, user_id, us AS event_timestamp, session_id FROM ({_sessions(120)})""",
    "sessionize_3600": f"""
      SELECT event_id, user_id, us AS event_timestamp, session_id FROM ({_sessions(3600)})""",
    "mark_sessions": f"""
      SELECT event_id, user_id, us AS event_timestamp, prev AS prev_us, secs AS seconds_since_last,
             fresh AS is_new_session FROM ({_sessions(3600)})""",
    "session_durations": _DURATIONS,
    "session_durations_stream": _DURATIONS,
    "session_stats_cr": _STATS,
    "session_stats_unity": f"""
      SELECT user_id, count(*) AS engagement_event_count,
             round(sum(session_duration_sec) / 60.0::DOUBLE, 1) AS total_time_minutes,
             round(avg(session_duration_sec) / 60.0::DOUBLE, 1) AS avg_session_length_minutes
      FROM ({_DURATIONS}) GROUP BY 1""",
    "best_row_cr": "SELECT * FROM best",
    "best_row_unity": """
      SELECT country AS user_pseudo_id, user_pseudo_id AS device, max_user_level, first_open
      FROM old_progress
      QUALIFY row_number() OVER (PARTITION BY country
        ORDER BY max_user_level DESC, first_open, user_pseudo_id) = 1""",
    "duplicate_keys": """
      SELECT cr_user_id, user_pseudo_id, app_language, first_open, cohort_name,
             count(*) OVER (PARTITION BY user_pseudo_id) > 1 AS is_duplicate FROM launch""",
    "dedupe_rows": """
      SELECT cr_user_id, app_language, first_open FROM launch
      QUALIFY row_number() OVER (PARTITION BY cr_user_id
        ORDER BY first_open DESC NULLS LAST, app_language NULLS LAST) = 1""",
    "single_language_users": "SELECT * FROM clean_users",
    "single_language_launch": "SELECT * FROM clean_launch",
    "load_clean": """
      SELECT 'progress' AS source, count(*) AS n, count(first_open) AS with_first_open,
             CAST(sum(max_user_level) AS BIGINT) AS levels,
             CAST(sum(CASE WHEN active_span < 0 THEN 0 ELSE active_span END) AS BIGINT) AS span
      FROM clean_users
      UNION ALL
      SELECT 'legacy', count(*), count(first_open), CAST(sum(max_user_level) AS BIGINT),
             CAST(sum(active_span) AS BIGINT) FROM old_progress
      UNION ALL
      SELECT 'launches', count(*), count(first_open), NULL, NULL FROM clean_launch""",
    "clean_progress": "SELECT * REPLACE (CASE WHEN active_span < 0 THEN 0 ELSE active_span END AS active_span) FROM clean_users",
    "clean_legacy": "SELECT * FROM old_progress",
    "clean_launches": "SELECT * FROM clean_launch",
    "export_read_back": "SELECT * FROM launch",
    "table_read_back": "SELECT * FROM old_progress",
    "csv_read_back": "SELECT * EXCLUDE (la_gpc) REPLACE (CASE WHEN active_span < 0 THEN 0 ELSE active_span END AS active_span) FROM co",
    "cohort_totals": f"SELECT count(*) AS LR, {_counts(_LONG)} FROM co",
    "funnel_by_group": _CR_FUNNEL,
    "funnel_by_language": _funnel("co", "app_language", _SHORT, "cr_user_id", "co_lr"),
    "funnel_unity": _funnel("co_unity", "country", _SHORT, "user_pseudo_id"),
    "funnel_all_apps": _funnel("co_all", "country", _SHORT, "cr_user_id"),
    "lr_by_group": """
      SELECT app_language, count(DISTINCT cr_user_id) AS LR, 100.0::DOUBLE AS LR_pct
      FROM co_lr GROUP BY 1""",
    "sorted_funnel": _CR_MAP,
    "top10": f"SELECT * FROM ({_CR_MAP}) ORDER BY LA DESC NULLS LAST, country LIMIT 10",
    "app_funnel": f"SELECT * REPLACE (round(GPP, 6) AS GPP, round(GCA, 6) AS GCA) FROM ({_THREE_APPS})",
    "all_apps_metrics": f"SELECT {_WEIGHTED} FROM ({_TWO_APPS})",
    "global_metrics": f"SELECT {_WEIGHTED} FROM ({_CR_LANGUAGE})",
    "active_countries": "SELECT country FROM old_progress UNION SELECT country FROM progress",
    "country_map": _CR_MAP,
    "country_map_lr": """
      SELECT country, count(DISTINCT cr_user_id) AS LR, 100.0::DOUBLE AS LR_pct
      FROM co_lr GROUP BY 1""",
    "funnel_steps": _steps(
        f"SELECT {', '.join(f'sum({s}) AS {s}' for s in ['LR', *_LONG])} FROM ({_CR_LANGUAGE})",
        ["LR", *_LONG],
    ),
    "report_top_lr": """
      SELECT country, count(DISTINCT cr_user_id) AS LR, 100.0::DOUBLE AS LR_pct
      FROM co_lr GROUP BY 1 ORDER BY LR DESC, country NULLS LAST LIMIT 10""",
    "report_top_language_percent": f"SELECT * FROM ({_funnel('co', 'app_language', _SHORT, 'cr_user_id', 'co_lr')}) ORDER BY LA_pct DESC NULLS LAST, app_language NULLS LAST LIMIT 10",
    "single_app_tiles": """
      SELECT 'CR' AS app, (SELECT count(*) FROM co_lr) AS LR,
             count(*) FILTER (WHERE max_user_level >= 1) AS LA,
             count(*) FILTER (WHERE max_user_level >= 25) AS RA,
             count(*) FILTER (WHERE max_user_level >= 1 AND gpc >= 90) AS GC FROM co""",
    "single_app_steps": _steps(
        f"SELECT {', '.join(f'sum({s}) AS {s}' for s in ['LR', *_LONG])} FROM ({_CR_LANGUAGE})",
        ["LR", *_LONG],
    ),
    "funnel_steps_medium": _steps(
        f"SELECT {', '.join(f'sum({s}) AS {s}' for s in _LONG)} FROM ({_CR_LANGUAGE})", _LONG,
    ),
    "funnel_steps_all_apps": _steps(
        f"SELECT {', '.join(f'sum({s}) AS {s}' for s in ['LR', *_SHORT])} FROM ({_TWO_APPS})",
        ["LR", *_SHORT],
    ),
    "engagement_tiles": f"""
      SELECT 'All' AS app, {_WEIGHTED} FROM ({_TWO_APPS})
      UNION ALL
      SELECT app, LR, LA, RA, GC, round(GPP, 6), round(GCA, 6) FROM ({_TWO_APPS}) WHERE app = 'CR'""",
    "combined_cohorts": """
      SELECT 'progress' AS source, 'CR' AS app, cr_user_id, user_pseudo_id, country, app_language,
             first_open, max_user_level, NULL AS app_version FROM co
      UNION ALL
      SELECT 'progress', 'Unity', NULL, user_pseudo_id, country, app_language, first_open,
             max_user_level, app_version FROM co_unity
      UNION ALL
      SELECT 'launches', 'CR', cr_user_id, user_pseudo_id, country, app_language, first_open,
             NULL, NULL FROM co_lr""",
    "campaign_rollup": _rolled(),
    "campaigns_by_date": _rolled("segment_date BETWEEN DATE '2024-07-01' AND DATE '2026-06-30'"),
    "campaign_costs": f"""
      SELECT country, app_language, cost, {", ".join(_each(s) for s in ["LR", "PC", "LA", "RA"])},
             {", ".join(_conversion(s) for s in ["PC", "LA", "RA"])}
      FROM (
        SELECT s.country, s.app_language, s.cost,
               (SELECT count(*) FROM clean_launch c WHERE c.country = s.country
                  AND c.app_language = s.app_language AND {_SEGMENT_COHORT}) AS LR,
               COALESCE(p.PC, 0) AS PC, COALESCE(p.LA, 0) AS LA, COALESCE(p.RA, 0) AS RA
        FROM (SELECT country, app_language, round_even(sum(cost) * 100, 0) / 100::DOUBLE AS cost
              FROM ({_rolled("segment_date BETWEEN DATE '2021-01-01' AND DATE '2027-12-31'")})
              WHERE country IS NOT NULL AND app_language IS NOT NULL GROUP BY 1, 2) s
        LEFT JOIN (SELECT country, app_language, {_counts(["PC", "LA", "RA"])} FROM clean_users
                   WHERE app = 'CR' AND {_SEGMENT_COHORT} GROUP BY 1, 2) p
          ON p.country = s.country AND p.app_language = s.app_language)""",
}


def _ranged(number: int, first: str, last: str) -> str:
    """The funnel by country of one range of days."""
    where = (f"WHERE first_open BETWEEN DATE '{first}' AND DATE '{last}' "
             "AND COALESCE(app_language, 'zulu') IN ('english', 'french', 'swahili', 'zulu')")
    users = f"(SELECT * FROM clean_users {where} AND app = 'CR')"
    reached = f"(SELECT * FROM clean_launch {where})"
    return f"SELECT {number} AS range_no, * FROM ({_funnel(users, 'country', _LONG, 'cr_user_id', reached)})"


_QUERIES |= {
    "app_versions_numeric": """
      SELECT 'All' AS app_version UNION ALL SELECT DISTINCT 'v1.0.' || k FROM src WHERE k >= 25""",
    "funnel_all_apps_coalesce": _funnel("co_any", "country", _SHORT, "any_id"),
    "unity_user_progress_dedupe": "SELECT * FROM old_progress_once",
    "single_language_launch_strict": "SELECT * FROM clean_launch_strict",
    "funnel_bitmaps": " UNION ALL ".join([
        _ranged(0, "2024-01-03", "2024-01-26"), _ranged(1, "2024-01-10", "2024-01-17"),
        _ranged(2, "2021-01-01", "2024-01-31"),
    ]),
    # read off one cube, but the same tables
    "cube_country_map": _QUERIES["country_map"],
    "cube_country_map_lr": _QUERIES["country_map_lr"],
    "cube_top_language_percent": _QUERIES["report_top_language_percent"],
    "cube_funnel_unity": _QUERIES["funnel_unity"],
    "cube_funnel_all_apps": _QUERIES["funnel_all_apps"],
    "cube_steps": _QUERIES["funnel_steps"],
    "cube_tiles": _QUERIES["single_app_tiles"],
}


def _needed(sql: str) -> list[str]:
    """Names of the CTEs a statement uses, directly or not, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in _CTES:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(_CTES[name])
    return [name for name in _CTES if name in found]


def _statement(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _needed(sql))
    return f"WITH {ctes}\nSELECT * FROM ({sql})" if ctes else sql


def oracle_sql() -> dict[str, str]:
    return {name: _statement(sql) for name, sql in _QUERIES.items()}
