"""Common table expressions of the SQL twins, by name."""

from __future__ import annotations

# name -> (tables it needs, body); a body may only use earlier names
CTES: dict[str, str] = {}

_BASE = """
SELECT *, event_type = 'signup' AND hr BETWEEN 20 AND 23 AND k < 40 AS can_switch,
  (event_id // 8) % 10 + 1 AS place
FROM (SELECT CAST(CAST(ts - INTERVAL 12 HOUR AS DATE) - DATE '1970-01-01' AS INTEGER) AS night,
       event_id, ts, {user}, event_type, value, hour(ts) AS hr,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
FROM events)"""

CTES["base"] = _BASE.format(user="user_id % 36 AS user_id")

CTES["switches"] = """
SELECT night, arg_min(event_id, (ts, event_id)) AS switch_id FROM base WHERE can_switch GROUP BY night"""

CTES["log"] = """
SELECT night, event_id AS event_seq, ts,
  CASE WHEN event_type IN ('purchase','view') AND k % 25 = 0 THEN 'R?'
       WHEN event_type IN ('purchase','view') THEN 'R' || user_id END AS tag,
  CASE WHEN event_type IN ('purchase','view') AND k % 7 = 3 THEN ''
       WHEN event_type IN ('purchase','view') THEN 'Ind' || user_id
       WHEN k % 2 = 0 THEN 'Test' ELSE '' END AS raw_label,
  CASE event_type WHEN 'purchase' THEN 'CondMod' || place
       WHEN 'click' THEN 'LS' || place
       WHEN 'view' THEN 'Reader' || place ELSE 'exp' END AS unit_label,
  CASE WHEN k % 11 <> 0 THEN value * 10 END AS event_duration,
  CASE WHEN k % 22 <> 0 THEN value * 10 END AS sense_duration,
  CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN 0e0
       WHEN event_type = 'purchase' THEN value END AS reward_steps,
  CASE WHEN event_type = 'signup' AND hr = 12 AND k < 50 THEN 'start'
       WHEN event_type = 'signup' AND hr = 11 AND k < 50 THEN 'end'
       WHEN event_id = switch_id THEN 'switch'
       WHEN event_type = 'error' AND k < 50 THEN 'start pump'
       WHEN event_type = 'error' THEN 'end pump' ELSE '' END AS system_msg
FROM base LEFT JOIN switches USING (night)"""

CTES["conditions"] = """
SELECT night, night - (SELECT min(night) FROM base) - 1 AS group_night,
  'Ind' || user_id AS id_label, 'R' || user_id AS tag, c_acctbal AS weight,
  CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 'f' END AS sex,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD','MACHINERY') THEN 'mixed_' || lower(c_mktsegment)
       ELSE lower(c_mktsegment) END AS cohort,
  CASE c_custkey % 40 WHEN 1 THEN '1' WHEN 2 THEN '>22:04' WHEN 3 THEN '<18:30'
       WHEN 4 THEN '>02:00' WHEN 5 THEN '<01:15' ELSE '0' END AS discard,
  CASE WHEN night - (SELECT min(night) FROM base) - 1 < 1 THEN 'train' ELSE 'test' END AS cond
FROM (SELECT DISTINCT night, user_id FROM base) JOIN customer ON c_custkey = user_id"""

CTES["placed"] = """
SELECT *, row_number() OVER (PARTITION BY night ORDER BY ts, event_seq) AS pos FROM log"""

CTES["begins"] = """
SELECT night, coalesce(s, r) AS f FROM (
  SELECT night, max(CASE WHEN system_msg = 'start' THEN pos END) + 1 AS s,
    min(CASE WHEN raw_label <> 'Test' AND reward_steps > 0 THEN pos END) AS r
  FROM placed GROUP BY night)"""

CTES["ends"] = """
SELECT p.night, min(pos) - 1 AS e FROM placed p JOIN begins b ON p.night = b.night
WHERE system_msg = 'end' AND raw_label LIKE '%T%' AND pos > f GROUP BY p.night"""

CTES["trimmed"] = """
SELECT p.* FROM placed p JOIN begins USING (night) LEFT JOIN ends USING (night)
WHERE pos >= f AND (e IS NULL OR pos <= e)"""

CTES["phased"] = """
SELECT *, CAST(1 + sum(CASE WHEN system_msg = 'switch' THEN 1 ELSE 0 END) OVER (
    PARTITION BY night ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS phase
FROM trimmed"""

CTES["pumped"] = """
SELECT *, last_value(mark IGNORE NULLS) OVER (ORDER BY night, ts, event_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pumping
FROM (SELECT *, CASE WHEN ts = (SELECT min(ts) FROM trimmed) THEN 0e0
        WHEN system_msg LIKE '%start p%' THEN 1e0
        WHEN system_msg LIKE '%end p%' THEN 0e0 END AS mark FROM phased)"""

CTES["known"] = """
SELECT p.* EXCLUDE (event_duration), coalesce(event_duration, sense_duration) AS event_duration,
  c.id_label
FROM pumped p LEFT JOIN (SELECT night, tag, id_label FROM conditions) c USING (night, tag)"""

CTES["derived"] = """
SELECT *, coalesce(reward_steps, 0e0) / 2 AS vol,
  CASE WHEN coalesce(reward_steps, 0e0) / 2 > 0 THEN 1e0 ELSE 0e0 END AS rewarded,
  TRY_CAST(nullif(regexp_extract(unit_label, '([0-9].*)$', 1), '') AS INTEGER) AS loc
FROM known"""

CTES["anchors"] = """
SELECT night, id_label, CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS anchor
FROM derived WHERE id_label IS NOT NULL GROUP BY night, id_label"""

CTES["rules"] = """
SELECT night, id_label, anchor, discard,
  nullif(regexp_extract(discard, '>([0-9]{2}:[0-9]{2})', 1), '') AS t_after,
  nullif(regexp_extract(discard, '<([0-9]{2}:[0-9]{2})', 1), '') AS t_before
FROM conditions LEFT JOIN anchors USING (night, id_label)"""

CTES["windows"] = """
SELECT night, id_label, discard,
  CASE WHEN t_after IS NULL AND t_before IS NULL THEN NULL
       WHEN t_after IS NULL THEN anchor
       ELSE anchor + to_days(CASE WHEN t_after < '16:00' THEN 1 ELSE 0 END)
            + to_hours(CAST(substr(t_after, 1, 2) AS INTEGER))
            + to_minutes(CAST(substr(t_after, 4, 2) AS INTEGER)) END AS low,
  CASE WHEN t_after IS NULL AND t_before IS NULL THEN NULL
       WHEN t_before IS NULL THEN anchor + to_days(2)
       ELSE anchor + to_days(CASE WHEN t_before < '16:00' THEN 1 ELSE 0 END)
            + to_hours(CAST(substr(t_before, 1, 2) AS INTEGER))
            + to_minutes(CAST(substr(t_before, 4, 2) AS INTEGER)) END AS high
FROM rules"""

CTES["kept"] = """
SELECT d.*, c.group_night, c.weight, c.sex, c.cohort, c.cond
FROM derived d
LEFT JOIN conditions c ON d.night = c.night AND d.id_label = c.id_label
LEFT JOIN windows w ON d.night = w.night AND d.id_label = w.id_label
WHERE NOT coalesce(w.discard = '1' OR coalesce(ts BETWEEN low AND high, FALSE), FALSE)"""

CTES["event_table"] = """
SELECT night, event_seq, ts, id_label, tag, unit_label, event_duration, system_msg, pumping,
  phase, vol, rewarded, loc,
  CASE WHEN loc < 6 THEN 1 WHEN loc > 5 THEN 2 END AS patch,
  loc IS NOT NULL AND unit_label LIKE '%Cond%' AS choice,
  last_value(group_night IGNORE NULLS) OVER w AS group_night, weight, sex,
  last_value(cohort IGNORE NULLS) OVER w AS cohort,
  last_value(cond IGNORE NULLS) OVER w AS cond
FROM kept WHERE hour(ts) > 15 OR hour(ts) < 4
WINDOW w AS (ORDER BY ts, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

CTES["hits"] = """
SELECT *, CASE WHEN hit THEN id_1 END AS counterpart FROM (
  SELECT *, CASE WHEN n_event < 2 THEN FALSE WHEN id_label IS NULL THEN FALSE
    WHEN event_duration >= 2000 THEN FALSE WHEN NOT unit_label LIKE '%Re%' THEN FALSE
    WHEN NOT unit_1 LIKE '%Co%' THEN FALSE ELSE TRUE END AS hit
  FROM (SELECT *, row_number() OVER w AS n_event, lag(unit_label) OVER w AS unit_1,
          lag(id_label) OVER w AS id_1
        FROM event_table WINDOW w AS (PARTITION BY night ORDER BY ts, event_seq)))"""

CTES["durations"] = """
SELECT night, 1 AS phase, h AS phase_dur FROM (
  SELECT night, round(date_diff('microsecond', min(ts), max(ts)) / 3.6e9, 1) AS h
  FROM hits WHERE n_event = 1 OR system_msg = 'switch' GROUP BY night)
UNION ALL
SELECT night, 2, 12 - h FROM (
  SELECT night, round(date_diff('microsecond', min(ts), max(ts)) / 3.6e9, 1) AS h
  FROM hits WHERE n_event = 1 OR system_msg = 'switch' GROUP BY night)"""

CTES["visits0"] = """
SELECT v.*, phase_dur, n / nullif(phase_dur, 0) AS vis_hour,
  vol_consumed / nullif(phase_dur, 0) AS ml_hour
FROM (SELECT night, cohort, group_night, id_label, phase, cond, patch, sex, count(*) AS n,
        sum(vol) / 1000 AS vol_consumed
      FROM hits WHERE event_duration > 300 AND choice AND id_label IS NOT NULL
      GROUP BY ALL) v LEFT JOIN durations d USING (night, phase)"""

CTES["rev"] = """
SELECT cohort, group_night,
  CAST(row_number() OVER (PARTITION BY cohort ORDER BY group_night DESC) AS INTEGER) AS rev_night
FROM (SELECT DISTINCT cohort, group_night FROM visits0 WHERE cond = 'test')"""

CTES["visits"] = """
SELECT v.*, rev_night FROM visits0 v LEFT JOIN rev USING (cohort, group_night)"""

CTES["games"] = """
SELECT cond, h.group_night, h.cohort, id_label, counterpart, loc, 1 AS outcome, rev_night
FROM hits h LEFT JOIN rev r ON h.cohort = r.cohort AND h.group_night = r.group_night WHERE hit"""


def of_every_user(sql: str) -> str:
    """The twin over the log in which every user is an individual."""
    return sql.replace(CTES["base"], _BASE.format(user="user_id"), 1)


def twin(needs: str, select: str) -> str:
    """``select`` behind every CTE up to the last one of ``needs``.

    DuckDB plans only those the select really uses.
    """
    names = list(CTES)
    last = max(names.index(n) for n in needs.split())
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in names[: last + 1])
    return f"WITH {ctes}\n{select}"
