"""DuckDB SQL of the engine's queries, over the CTE log of fixtures."""

from __future__ import annotations



EPS = "1e-10"



def ctes(log: str, *more: str) -> str:
    return "WITH " + ", ".join((log, *more))


HOURS = "hours AS (SELECT geo_location, date_trunc('hour', ts) AS hr, count(*) AS n, count(DISTINCT usr) AS users FROM log GROUP BY 1, 2)"
CLOCK = "clock AS (SELECT geo_location, hour(ts) AS h, count(*) AS n FROM log GROUP BY 1, 2)"
DAYS = "days AS (SELECT geo_location, date_trunc('day', ts) AS d, count(*) AS n FROM log GROUP BY 1, 2)"
WEEKS = "weeks AS (SELECT geo_location, date_trunc('week', ts) AS w, count(*) AS n FROM log GROUP BY 1, 2)"
USERS = "users AS (SELECT geo_location, usr, count(*) AS n FROM log WHERE usr IS NOT NULL GROUP BY 1, 2)"
FILES = "files AS (SELECT geo_location, filename, count(*) AS n, count(DISTINCT usr) AS users FROM log WHERE filename IS NOT NULL GROUP BY 1, 2)"
BASIC = """basic AS (
  SELECT geo_location, min(country) AS country, max(city) AS city, count(DISTINCT usr) AS unique_users, count(*) AS total_downloads,
    count(DISTINCT date_trunc('hour', ts)) AS active_hours, count(DISTINCT year(ts)) AS years_active, min(year(ts)) AS first_year,
    max(year(ts)) AS last_year, count(DISTINCT accession) AS unique_projects,
    count(*) / greatest(count(DISTINCT usr), 1) AS downloads_per_user
  FROM log GROUP BY geo_location)"""
YEARLY = f"""y0 AS (SELECT geo_location, year(ts) AS yr, count(*) AS n FROM log GROUP BY 1, 2),
yg AS (SELECT count(DISTINCT yr) AS y, max(yr) AS latest FROM y0),
yd AS (SELECT l.geo_location, a.yr, coalesce(y0.n, 0) AS n FROM (SELECT DISTINCT geo_location FROM y0) l
  CROSS JOIN (SELECT DISTINCT yr FROM y0) a LEFT JOIN y0 ON y0.geo_location = l.geo_location AND y0.yr = a.yr),
yp AS (SELECT *, n / sum(n) OVER (PARTITION BY geo_location) AS p FROM yd),
yq AS (SELECT *, (p + {EPS}) / sum(p + {EPS}) OVER (PARTITION BY geo_location) AS q FROM yp),
years AS (
  SELECT geo_location, sum(n) FILTER (yr = latest)::BIGINT AS latest_year_downloads,
    sum(n) FILTER (yr = latest) / sum(n) AS fraction_latest_year,
    (min(yr) FILTER (n > 0) = max(latest) AND count(*) FILTER (n > 0) = 1)::INTEGER AS is_new_location,
    CASE WHEN coalesce(sum(n) FILTER (yr <> latest), 0) > 0 THEN sum(n) FILTER (yr = latest)
      / (sum(n) FILTER (yr <> latest) / count(*) FILTER (yr <> latest AND n > 0) + {EPS})
      ELSE sum(n) FILTER (yr = latest) / 1000 END AS spike_ratio,
    count(*) FILTER (yr <> latest AND n > 0) AS years_before_latest,
    -sum(q * ln(q)) AS yearly_entropy, max(p) AS peak_year_concentration,
    CASE WHEN count(*) FILTER (n > 0) > 1 THEN stddev_samp(p) / (avg(p) + {EPS}) ELSE 0 END AS year_over_year_cv,
    count(*) FILTER (n > 0) AS years_span, sum(n) / count(*) FILTER (n > 0) AS downloads_per_year
  FROM yq, yg GROUP BY geo_location)"""
DENSE = f"""dense AS (SELECT l.geo_location, h.h, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT geo_location FROM clock) l
  CROSS JOIN (SELECT unnest(range(24)) AS h) h LEFT JOIN clock c ON c.geo_location = l.geo_location AND c.h = h.h),
dp AS (SELECT *, n / sum(n) OVER (PARTITION BY geo_location) AS p FROM dense),
dq AS (SELECT *, (p + {EPS}) / sum(p + {EPS}) OVER (PARTITION BY geo_location) AS q FROM dp),
tod AS (
  SELECT geo_location, stddev_pop(n) AS hourly_download_std, max(p) AS peak_hour_concentration,
    coalesce(sum(n) FILTER (h >= 9 AND h < 17), 0)::DOUBLE / sum(n)::DOUBLE AS working_hours_ratio, -sum(q * ln(q)) AS hourly_entropy,
    coalesce(sum(n) FILTER (h >= 22 OR h < 6), 0)::DOUBLE / sum(n)::DOUBLE AS night_activity_ratio
  FROM dq GROUP BY geo_location)"""
PROTOCOL = """protocol AS (
  SELECT geo_location, avg((lower(method) = 'http')::INT) AS http_ratio, avg((lower(method) = 'ftp')::INT) AS ftp_ratio,
    avg((lower(method) LIKE '%aspera%')::INT) AS aspera_ratio, avg((lower(method) LIKE '%globus%')::INT) AS globus_ratio,
    count(DISTINCT method) AS protocol_diversity,
    0.9 * avg((lower(method) LIKE '%aspera%')::INT) + 0.95 * avg((lower(method) LIKE '%globus%')::INT)
      + 0.6 * avg((lower(method) = 'ftp')::INT) + 0.1 * avg((lower(method) = 'http')::INT) AS protocol_legitimacy_score
  FROM log GROUP BY geo_location)"""
SESSIONS = """gaps AS (SELECT geo_location, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY geo_location ORDER BY ts, event_id))) / 1e6 AS gap FROM log),
marks AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY geo_location ORDER BY ts) AS session FROM gaps),
sessions AS (SELECT geo_location, session, min(hour(ts)) AS hr, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration,
  max(CASE WHEN gap > 1800 THEN gap END) AS before FROM marks GROUP BY 1, 2)"""


def sampled(most: int) -> str:
    return f"""sampled AS (SELECT geo_location, ts, event_id FROM log
  QUALIFY row_number() OVER (PARTITION BY geo_location ORDER BY md5(event_id::VARCHAR), event_id) <= {most}),
sgaps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY geo_location ORDER BY ts, event_id))) / 1e6 AS gap FROM sampled)"""

#: Intervals between all events, from the gaps of sessions.
EVERY = "sgaps AS (SELECT geo_location, gap FROM gaps)"

BASE = """week AS (SELECT geo_location, sum(CASE WHEN dayofweek(d) IN (0, 6) THEN n ELSE 0 END) / sum(n) AS weekend_ratio,
    count(DISTINCT dayofweek(d)) AS unique_days_of_week, sum(n) AS n FROM days GROUP BY 1),
inter AS (SELECT geo_location, avg(gap) AS mean_interval, stddev_samp(gap) AS std_interval,
    CASE WHEN avg(gap) > 0 THEN stddev_samp(gap) / avg(gap) ELSE 1.0 END AS interval_cv,
    CASE WHEN stddev_samp(gap) > 0 THEN avg(gap) / (stddev_samp(gap) + 1) ELSE 0 END AS regularity_score FROM sgaps GROUP BY 1),
fcount AS (SELECT geo_location, count(*) AS unique_files, max(n) / sum(n) AS file_concentration, count(*) / sum(n) AS file_diversity_ratio FROM files GROUP BY 1),
runs AS (SELECT geo_location, count(*) AS num_sessions FROM sessions GROUP BY 1),
bb AS (SELECT week.geo_location, weekend_ratio, unique_days_of_week, mean_interval, std_interval, interval_cv, regularity_score, unique_files,
    file_concentration, file_diversity_ratio, num_sessions, n / num_sessions AS downloads_per_session
  FROM week LEFT JOIN inter USING (geo_location) LEFT JOIN fcount USING (geo_location) LEFT JOIN runs USING (geo_location)),
base_behavior AS (SELECT *, (regularity_score > (SELECT quantile_cont(regularity_score, 0.75) FROM bb))::INT::DOUBLE AS is_mechanical,
    (weekend_ratio < 0.15)::INT::DOUBLE AS is_weekday_biased, (file_diversity_ratio < 0.1)::INT::DOUBLE AS is_single_file,
    (downloads_per_session > (SELECT quantile_cont(downloads_per_session, 0.75) FROM bb))::INT::DOUBLE AS is_bursty FROM bb)"""

#: Labels of the location profile by the live rules.
LABELS = """conc AS (SELECT geo_location, CASE WHEN count(*) > 1 THEN CASE WHEN stddev_samp(users) > 0 THEN avg(users) / stddev_samp(users) ELSE 0 END END AS user_coordination_score FROM hours GROUP BY 1),
prof AS (SELECT b.*, working_hours_ratio, night_activity_ratio, hourly_entropy, interval_cv, regularity_score, user_coordination_score
  FROM basic b LEFT JOIN tod USING (geo_location) LEFT JOIN base_behavior USING (geo_location) LEFT JOIN conc USING (geo_location)),
l1 AS (SELECT *, CASE
    WHEN regularity_score >= 0.7 OR (working_hours_ratio <= 0.25 AND night_activity_ratio >= 0.35)
      OR (user_coordination_score >= 0.6 AND unique_users >= 100)
      OR downloads_per_user >= 500 OR (unique_users >= 1000 AND downloads_per_user <= 50) THEN 'automated'
    WHEN (working_hours_ratio >= 0.4 AND regularity_score <= 0.6) OR interval_cv >= 0.7
      OR (unique_users <= 50 AND downloads_per_user BETWEEN 1 AND 200) THEN 'organic'
    WHEN unique_users <= 100 THEN 'organic' ELSE 'automated' END AS behavior_type FROM prof),
l2 AS (SELECT *, CASE WHEN behavior_type <> 'automated' THEN NULL
    WHEN (downloads_per_user >= 500 AND unique_users <= 100)
      OR (total_downloads >= 100000 AND downloads_per_user BETWEEN 50 AND 500 AND working_hours_ratio >= 0.25)
      OR (unique_users <= 10 AND regularity_score >= 0.7 AND downloads_per_user BETWEEN 20 AND 500)
      OR (unique_users <= 5 AND regularity_score >= 0.6 AND downloads_per_user >= 50) THEN 'legitimate_automation'
    WHEN (unique_users >= 1000 AND downloads_per_user <= 50) OR (unique_users >= 10000 AND downloads_per_user <= 10)
      OR (night_activity_ratio >= 0.5 AND unique_users >= 500 AND working_hours_ratio <= 0.2) THEN 'bot'
    WHEN unique_users > 500 AND downloads_per_user < 100 THEN 'bot' WHEN downloads_per_user >= 100 THEN 'legitimate_automation'
    ELSE 'bot' END AS automation_category FROM l1),
labels AS (SELECT *, coalesce(automation_category = 'bot', false) AS is_bot,
    coalesce(automation_category = 'legitimate_automation', false) AS is_hub, behavior_type = 'organic' AS is_organic FROM l2)"""

#: Reference labels by ordered heuristics: the number of the first that holds, and what it stands for.
GROUND_TRUTH = """chain AS (SELECT geo_location, unique_users AS u, downloads_per_user AS d, total_downloads AS t, working_hours_ratio AS w, night_activity_ratio AS n FROM basic JOIN tod USING (geo_location)),
truth AS (SELECT geo_location, x.label AS ground_truth_label, x.sure AS ground_truth_confidence, x.why AS ground_truth_criteria FROM (SELECT geo_location, CASE
    WHEN u >= 10000 AND d <= 10 THEN {'label': 'bot', 'sure': 0.99, 'why': 'users>=10000 dpu<=10'}
    WHEN u >= 5000 AND d <= 25 THEN {'label': 'bot', 'sure': 0.95, 'why': 'users>=5000 dpu<=25'}
    WHEN u >= 1000 AND d <= 50 AND w <= 0.3 THEN {'label': 'bot', 'sure': 0.90, 'why': 'users>=1000 dpu<=50 working<=0.3'}
    WHEN u <= 5 AND d >= 1000 THEN {'label': 'hub', 'sure': 0.95, 'why': 'users<=5 dpu>=1000'}
    WHEN u <= 20 AND d >= 500 THEN {'label': 'hub', 'sure': 0.90, 'why': 'users<=20 dpu>=500'}
    WHEN u BETWEEN 10 AND 200 AND d >= 200 AND t >= 100000 AND w >= 0.2 THEN {'label': 'hub', 'sure': 0.85, 'why': 'users 10-200 dpu>=200 total>=100000 working>=0.2'}
    WHEN u <= 3 AND d <= 20 AND w >= 0.4 THEN {'label': 'organic', 'sure': 0.95, 'why': 'users<=3 dpu<=20 working>=0.4'}
    WHEN u BETWEEN 3 AND 30 AND d BETWEEN 5 AND 100 AND w >= 0.35 THEN {'label': 'organic', 'sure': 0.90, 'why': 'users 3-30 dpu 5-100 working>=0.35'}
    WHEN u <= 5 AND d <= 50 AND n <= 0.3 THEN {'label': 'organic', 'sure': 0.85, 'why': 'users<=5 dpu<=50 night<=0.3'}
    ELSE {'label': 'uncertain', 'sure': 0.0, 'why': ''} END AS x FROM chain))"""
