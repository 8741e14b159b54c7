"""The same results as plain SQL over the given tables, for cross-checking."""

from __future__ import annotations

PLAYS = """
plays AS (
  SELECT event_id, user_id, ts AS "timestamp", event_type AS artist_name, props AS track_name
  FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL AND props IS NOT NULL
)"""

ORDER_PLAYS = """
plays AS (
  SELECT o_orderkey AS event_id, o_custkey AS user_id, o_orderdate AS "timestamp",
         o_orderstatus AS artist_name, o_orderpriority AS track_name
  FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
    AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
)"""

GAPPY_PLAYS = """
plays AS (
  SELECT * FROM (
    SELECT event_id,
           CASE WHEN value < 0.5 THEN NULL ELSE user_id END AS user_id,
           CASE WHEN value BETWEEN 0.5 AND 1.0 THEN NULL ELSE ts END AS "timestamp",
           CASE WHEN event_type = 'view' THEN NULL ELSE props END AS artist_id,
           CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS artist_name,
           CAST(NULL AS VARCHAR) AS track_id,
           CASE WHEN props = '{"k": 0}' THEN NULL ELSE props END AS track_name
    FROM events)
  WHERE user_id IS NOT NULL AND "timestamp" IS NOT NULL
    AND artist_name IS NOT NULL AND track_name IS NOT NULL
)"""

# What a text log made of the events reads back as.
TEXT_PLAYS = """
plays AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS "timestamp",
         CAST(NULL AS VARCHAR) AS artist_id, event_type AS artist_name,
         CAST(NULL AS VARCHAR) AS track_id, props AS track_name,
         event_id
  FROM events
)"""


def sessionized(gap: int, order: str = "event_id") -> str:
    return f"""
lagged AS (
  SELECT *, lag("timestamp") OVER w AS prev_ts,
         date_diff('second', lag("timestamp") OVER w, "timestamp") AS gap
  FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", {order})
),
flagged AS (
  SELECT *, CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END AS new_session FROM lagged
),
sessionized AS (
  SELECT *, CAST(sum(new_session) OVER (
    PARTITION BY user_id ORDER BY "timestamp", {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_num
  FROM flagged
)"""


SESSIONS = """
sessions AS (
  SELECT user_id, session_num, count(*) AS track_count,
         min("timestamp") AS start_ts, max("timestamp") AS end_ts
  FROM sessionized GROUP BY user_id, session_num
)"""

TOP_SESSIONS = """
chosen AS (
  SELECT user_id, session_num, track_count FROM sessions
  ORDER BY track_count DESC, user_id, session_num LIMIT 50
)"""

RANKED_SONGS = """
SELECT CAST(row_number() OVER (ORDER BY play_count DESC, artist_name, track_name) AS INTEGER)
         AS rank, artist_name, track_name, play_count
FROM (SELECT artist_name, track_name, count(*) AS play_count
      FROM sessionized JOIN chosen USING (user_id, session_num)
      GROUP BY artist_name, track_name)
QUALIFY rank <= 10"""


def _session_rows(plays: str, gap: int, columns: str, order: str = "event_id") -> str:
    return f"""WITH {plays}, {sessionized(gap, order)}
SELECT {columns}, "timestamp", artist_name, track_name, user_id, prev_ts, gap, new_session,
       session_num, user_id || '_' || session_num AS session_id
FROM sessionized"""


def _top_songs(plays: str, gap: int) -> str:
    return f"WITH {plays}, {sessionized(gap)}, {SESSIONS}, {TOP_SESSIONS} {RANKED_SONGS}"


def _with_sessions(gap: int, select: str, plays: str = PLAYS) -> str:
    return f"WITH {plays}, {sessionized(gap)}, {SESSIONS} {select}"


# A damaged log's lines: their fields, and what is wrong with each.
LOG_LINES = """
fields AS (
  SELECT event_id, CASE WHEN value < 0.5 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id, ts, event_type,
         CASE WHEN event_type = 'error' THEN 'bad ' ELSE '' END || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS shown,
         CASE WHEN props = '{"k": 0}' THEN '' ELSE props END AS track,
         event_type = 'view' AND value BETWEEN 0.5 AND 1.0 AS short
  FROM events
),
lines AS (
  SELECT *, CASE WHEN short THEN concat_ws(chr(9), user_id, shown, '')
                 ELSE concat_ws(chr(9), user_id, shown, '', event_type, '', track) END AS line,
         concat_ws('; ', CASE WHEN short THEN 'wrong number of fields' END,
           CASE WHEN event_type = 'error' THEN 'unreadable timestamp' END, CASE WHEN user_id = '' THEN 'no user_id' END,
           CASE WHEN short THEN 'no artist_name' END, CASE WHEN short OR track = '' THEN 'no track_name' END) AS reasons
  FROM fields
),
plays AS (
  SELECT event_id, user_id, ts AS "timestamp" FROM lines WHERE reasons = ''
)"""

USER_COUNTS = "SELECT user_id, count(*) AS session_count FROM sessions GROUP BY user_id"

ORACLE = {
    "clean_plays": f"WITH {GAPPY_PLAYS} SELECT * FROM plays",
    "parse_timestamps": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
               TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad ' ELSE '' END
                        || CAST(ts AS VARCHAR) AS TIMESTAMP) AS "timestamp"
        FROM events""",
    "tsv_roundtrip": f"""WITH {TEXT_PLAYS}
        SELECT * EXCLUDE (event_id) FROM plays WHERE artist_name <> 'error'""",
    "tsv_quoted_roundtrip": f"WITH {TEXT_PLAYS} SELECT * EXCLUDE (event_id) FROM plays",
    "tsv_top_songs": _top_songs(TEXT_PLAYS, 1200),
    "sessionize": _session_rows(PLAYS, 1200, "event_id"),
    "sessionize_6h": _session_rows(PLAYS, 21600, "event_id"),
    "sessionize_ties": _session_rows(ORDER_PLAYS, 1200, "event_id"),
    "sessionize_copies": f"""WITH {ORDER_PLAYS}, {sessionized(1200, "artist_name, track_name")}
        SELECT "timestamp", artist_name, track_name, user_id, prev_ts, gap, new_session,
               session_num, user_id || '_' || session_num AS session_id
        FROM sessionized""",
    "sessionize_null_ties": f"""WITH untied AS (WITH {ORDER_PLAYS} SELECT * FROM plays),
        plays AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 END AS tie FROM untied),
        {sessionized(1200, "tie NULLS FIRST, event_id")}
        SELECT event_id, tie, "timestamp", artist_name, track_name, user_id, prev_ts, gap,
               new_session, session_num, user_id || '_' || session_num AS session_id
        FROM sessionized""",
    "session_table": _with_sessions(
        1200, "SELECT *, user_id || '_' || session_num AS session_id FROM sessions"
    ),
    "session_table_bucketed": _with_sessions(1200, "SELECT * FROM sessions"),
    "tsv_rejects": f"WITH {LOG_LINES} SELECT line, reasons FROM lines WHERE reasons <> ''",
    "tsv_rejects_kept": _with_sessions(1200, "SELECT * FROM sessions", LOG_LINES),
    "tsv_reject_reasons": f"""WITH {LOG_LINES}
        SELECT CASE WHEN reasons = '' THEN 'play' ELSE reasons END AS reasons, count(*) AS n_lines FROM lines GROUP BY 1""",
    "sessions_incremental": _with_sessions(1200, "SELECT * FROM sessions"),
    "sessions_rewritten": _with_sessions(1200, "SELECT * FROM sessions"),
    "sessions_stream": _with_sessions(1200, "SELECT * FROM sessions"),
    "sessions_of_gappy_log": _with_sessions(21600, "SELECT * FROM sessions", GAPPY_PLAYS),
    "top_sessions": _with_sessions(
        1200,
        f""", {TOP_SESSIONS} SELECT user_id || '_' || session_num AS session_id, user_id,
        session_num, track_count FROM chosen""",
    ),
    "top_songs": _top_songs(PLAYS, 1200),
    "top_songs_6h": _top_songs(PLAYS, 21600),
    "top_songs_file": _top_songs(PLAYS, 1200),
    "user_session_counts": _with_sessions(1200, USER_COUNTS),
    "top_user": _with_sessions(
        1200, f"{USER_COUNTS} ORDER BY session_count DESC, user_id LIMIT 1"
    ),
}
