"""Event logs laid over the star-schema tables, as Spark views and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.schema import canonical, get_schema

_A = """
SELECT CAST(n.n_nationkey*3-40 AS {S}) || ',' || CAST(e.user_id % 4 AS {S}) AS geo_location,
       n.n_name AS country, 'city_' || CAST(e.user_id % 4 AS {S}) AS city, CAST(e.user_id AS {S}) AS usr,
       'DS' || lpad(regexp_extract(e.props, '([0-9]+)', 1), 6, '0') AS accession,
       CASE e.event_type WHEN 'view' THEN 'http' WHEN 'click' THEN 'ftp' WHEN 'signup' THEN 'fasp-aspera'
            WHEN 'purchase' THEN 'gridftp-globus' ELSE 'http' END AS method,
       'file_' || regexp_extract(e.props, '([0-9]+)', 1) || '_v1.' || CAST(e.event_id % 3 AS {S}) || '.0.raw' AS filename,
       e.ts, e.event_id
FROM {events} e JOIN {nation} n ON n.n_nationkey = e.user_id % 25
"""

_B = """
SELECT CAST(c.c_nationkey AS {S}) || ',' || CAST(ascii(c.c_mktsegment) AS {S}) AS geo_location,
       n.n_name AS country, CAST(NULL AS {S}) AS city, CAST(o.o_custkey AS {S}) AS usr,
       'P' || CAST(l.l_partkey AS {S}) AS accession, CAST(NULL AS {S}) AS method, CAST(NULL AS {S}) AS filename,
       CAST(l.l_shipdate AS {N}) AS ts, CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS event_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
     JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

#: Kinds of locations: id, orders from and up to (of each block of 15,000), events an order, places, users a place, first hour, hours
#: a day, days between days, events an hour, events in a first hour of their own, transfer methods, datasets, files.
#: Each kind meets one bound or branch of the rules, seeds, reference labels or hub protection; the last one takes all other orders.
KINDS_C = (
    (1, 0, 15, 30, 10, 3, 10, 4, 30, 15, 0, 0, 9, 20),  # a few people in working hours
    (2, 15, 105, 40, 6, 20, 9, 2, 20, 60, 0, 4, 40, 70),  # a working group
    (3, 105, 129, 40, 8, 4, 17, 5, 9, 6, 0, 0, 12, 30),  # evenings
    (4, 129, 153, 40, 30, 8, 10, 4, 400, 4, 0, 0, 5, 9),  # seeds of organic use: two years, few events
    (5, 153, 249, 40, 12, 40, 9, 8, 1, 1, 0, 0, 30, 60),  # one event an hour
    (6, 249, 285, 40, 8, 150, 12, 3, 2, 1, 150, 1, 60, 90),  # a first hour of all users
    (7, 285, 360, 40, 10, 30, 22, 8, 1, 2, 0, 0, 25, 100),  # at night
    (8, 360, 370, 40, 5, 1, 0, 24, 1, 1, 0, 0, 20, 40),  # one busy user
    (9, 370, 400, 30, 5, 60, 9, 10, 3, 9, 0, 2, 15, 25),  # fast transfers
    (10, 400, 436, 40, 6, 6, 0, 24, 1, 1, 0, 1, 10, 12),  # a regular job
    (11, 436, 496, 40, 1, 1200, 17, 6, 1, 40, 0, 0, 50, 200),  # over a thousand users out of hours
    (12, 496, 616, 40, 2, 2, 0, 24, 1, 20, 0, 3, 300, 700),  # mirrors with fast transfers
    (13, 616, 772, 40, 1, 12, 0, 24, 1, 20, 0, 0, 400, 900),  # a mirror without
    (14, 772, 847, 40, 1, 5, 22, 8, 1, 30, 0, 0, 300, 600),  # a mirror at odd hours
    (15, 847, 947, 40, 1, 100, 0, 24, 1, 30, 0, 4, 80, 100),  # nothing certain
    (16, 947, 1022, 40, 1, 300, 17, 8, 1, 20, 0, 2, 30, 40),  # out of hours, few events a user, fast transfers
    (17, 1022, 1198, 40, 4, 8, 8, 12, 2, 11, 0, 0, 90, 120),  # many events of few users
    (18, 1198, 1348, 40, 1, 600, 18, 8, 1, 40, 0, 0, 70, 90),  # half at night
    (19, 1348, 1498, 40, 1, 600, 17, 8, 1, 40, 0, 0, 70, 90),  # less than half at night
    (20, 1498, 1773, 40, 1, 110, 17, 8, 1, 50, 0, 1, 200, 500),  # a hundred events a user
    (21, 1773, 2023, 30, 1, 50, 6, 18, 1, 30, 0, 0, 150, 250),  # an institution's proxy
    (22, 2023, 2298, 40, 1, 5500, 22, 8, 1, 50, 0, 0, 100, 100),  # a farm at night
    (23, 2298, 2823, 20, 1, 10500, 0, 24, 1, 20, 0, 0, 100, 100),  # a farm all day
    (24, 2823, 3213, 40, 1, 600, 0, 24, 1, 40, 0, 3, 15600, 15600),  # over fifteen thousand datasets
    (25, 3213, 5713, 40, 1, 200, 0, 24, 1, 20, 0, 4, 2000, 5000),  # an institution
    (0, 5713, 15000, 1, 50, 15, 8, 12, 5, 2, 0, 4, 45, 60),  # all others
)
#: Countries by number of the nation; others keep the nation's name.
COUNTRIES_C = (
    "China", "Japan", "India", "United States", "Canada", "Brazil", "United Kingdom", "Germany", "France", "Spain", "Italy",
    "Australia", "New Zealand", "South Africa", "Egypt", "Saudi Arabia", "Iran", "%{{country}}", "",
)
#: Endings of file names.
ENDINGS_C = ("raw", "RAW", "wiff", "d", "mzML", "mzXML", "mgf", "mgf.gz", "mzid", "xml", "txt", "csv", "zip", "pdf")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(repr, row)) + ")" for row in rows)


_C = f"""
SELECT CAST(x.id * 3 - 40 AS {{S}}) || '.' || lpad(CAST(x.part AS {{S}}), 2, '0') || ',' || CAST(x.block % 340 - 170 AS {{S}}) || '.' || lpad(CAST(x.part * 7 % 100 AS {{S}}), 2, '0') AS geo_location,
       coalesce(c.country, n.n_name) AS country, 'city_' || CAST(x.part % 7 AS {{S}}) AS city,
       CASE WHEN x.id = 0 AND x.q % 50 = 7 THEN NULL ELSE 'u' || CAST(x.block AS {{S}}) || '_' || CAST(x.id AS {{S}}) || '_' || CAST(x.part AS {{S}}) || '_' || CAST(x.q % x.users AS {{S}}) END AS usr,
       'DS' || lpad(CAST(x.q % x.datasets AS {{S}}), 6, '0') AS accession,
       CASE WHEN x.methods = 1 OR x.methods = 4 AND x.q % 4 = 1 THEN 'ftp' WHEN x.methods = 2 AND x.q % 10 < 4 OR x.methods = 4 AND x.q % 20 = 2 THEN 'fasp-aspera'
            WHEN x.methods = 3 AND x.q % 10 < 2 THEN 'gridftp-globus' ELSE 'http' END AS method,
       'file_' || CAST(x.q % x.files AS {{S}}) || '_v1.' || CAST(x.q % x.files % (1 + x.id % 5) AS {{S}}) || '.0.' || e.ending AS filename,
       {{A}}(CASE WHEN x.q < x.head THEN 0 ELSE CAST(floor(x.slot / x.hours) AS BIGINT) * x.days END) * 86400
         + (x.first_hour + CASE WHEN x.q < x.head THEN 0 ELSE x.slot % x.hours END) * 3600
         + (CASE WHEN x.q < x.head THEN x.q ELSE x.q % x.rate END) * CAST(floor(3500 / greatest(x.rate, x.head)) AS BIGINT) + x.o_orderkey * 37 % 10{{Z}} AS ts,
       x.event_id
FROM (
  SELECT *, CAST(floor((q - head) / rate) AS BIGINT) + CASE WHEN head > 0 THEN 1 ELSE 0 END AS slot FROM (
    SELECT k.*, o.o_orderkey, CAST(floor(o.o_orderkey / 15000) AS BIGINT) AS block, o.o_orderkey * 64 + j AS event_id,
           ((o.o_orderkey % 15000 - k.low) * k.copies + j) % k.places AS part, CAST(floor(((o.o_orderkey % 15000 - k.low) * k.copies + j) / k.places) AS BIGINT) AS q
    FROM (SELECT {{H}} o_orderkey FROM {{orders}}) o
    JOIN (SELECT * FROM (VALUES {_values(KINDS_C)}) AS v(id, low, high, copies, places, users, first_hour, hours, days, rate, head, methods, datasets, files)) k
      ON o.o_orderkey % 15000 >= k.low AND o.o_orderkey % 15000 < k.high
    JOIN {{R}} ON j < k.copies
  ) y
) x
JOIN {{nation}} n ON n.n_nationkey = (x.id * 7 + CAST(floor(x.part / 10) AS BIGINT) + x.block) % 25
LEFT JOIN (VALUES {_values(enumerate(COUNTRIES_C))}) AS c(place, country) ON c.place = n.n_nationkey
JOIN (VALUES {_values(enumerate(ENDINGS_C))}) AS e(place, ending) ON e.place = x.q % x.files % {len(ENDINGS_C)}
"""

TABLES = ("events", "nation", "lineitem", "orders", "customer")
_START = "2021-01-04 00:00:00"
_DUCK = {"S": "VARCHAR", "N": "TIMESTAMP", "A": f"TIMESTAMP '{_START}' + to_seconds(", "Z": ")", "R": "(SELECT range AS j FROM range(64)) r", "H": ""} | {t: t for t in TABLES}
_SPARK = {"S": "STRING", "N": "TIMESTAMP_NTZ", "A": "timestampadd(SECOND, ", "Z": f", TIMESTAMP_NTZ '{_START}')", "R": "(SELECT id AS j FROM range(64)) r", "H": "/*+ REPARTITION_BY_RANGE({parts}, o_orderkey) */"}

#: One month with a fine clock, protocols and files; CTE named log.
LOG_A = f"log AS ({_A.format(**_DUCK)})"
#: Several years at midnight, more users a location; CTE named log.
LOG_B = f"log AS ({_B.format(**_DUCK)})"
#: Locations of every class, on both sides of the rules' bounds; CTE named log.
LOG_C = f"log AS MATERIALIZED ({_C.format(**_DUCK)})"


#: Orders of view C that one task turns into events, and tasks at least.
ORDERS_C, TASKS_C = 50_000, 32


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return canonical(spark.sql(sql.format(**_SPARK, **paths)), get_schema("canonical"))


def view_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _A)


def view_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _B)


def view_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are dealt by ranges of their keys, so that a location's events stay together, as those of a day do in a log by time."""
    parts = max(TASKS_C, -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // ORDERS_C))
    return _view(spark, sf_dir, _C.replace("{H}", _SPARK["H"].format(parts=parts)))
