"""Domain views over the test tables: sensor readings, deployments, grid topology.

The SQL text is plain enough for Spark and for the checking database, which
inlines it as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READINGS_SQL = """
SELECT user_id AS core_id, CAST(ts AS TIMESTAMP) AS time, event_id,
  event_type <> 'error' AS is_powered,
  CAST(7007 + event_id % 6 AS INT) AS product_id,
  CAST(event_id * 1000 AS DOUBLE) AS millis,
  CASE WHEN event_id % 7 = 0 THEN CAST(0 AS DOUBLE)
       WHEN event_id % 11 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 17 = 0 THEN CAST(event_id * 1000 + 500 AS DOUBLE)
       ELSE CAST(event_id * 1000 - FLOOR(value) * 1000 AS DOUBLE) END AS last_unplug_millis,
  CASE WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE)
       WHEN event_id % 19 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(event_id * 1000 - (event_id % 120) * 1000 AS DOUBLE) END AS last_plug_millis,
  CAST(event_id % 11 AS DOUBLE) AS gps_satellites,
  CAST(5.55 AS DOUBLE) + CAST((user_id * 37) % 101 AS DOUBLE) / 1000
    + (CAST(event_id % 9 AS DOUBLE) - 4) / 100000 AS gps_latitude,
  CASE WHEN event_id % 23 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN event_id % 29 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE CAST(-0.30 AS DOUBLE) + CAST((user_id * 53) % 97 AS DOUBLE) / 1000
         + (CAST(event_id % 7 AS DOUBLE) - 3) / 100000 END AS gps_longitude
FROM {events}
"""

DEPLOYMENT_SQL = """
SELECT c_custkey AS core_id,
  CAST(5.55 AS DOUBLE) + CAST((c_custkey * 37) % 101 AS DOUBLE) / 1000 AS location_latitude,
  CAST(-0.30 AS DOUBLE) + CAST((c_custkey * 53) % 97 AS DOUBLE) / 1000 AS location_longitude,
  CAST(c_nationkey * 5 AS VARCHAR(8)) AS site_id,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(NULL AS TIMESTAMP)
       ELSE TIMESTAMP '2024-01-04 00:00:00' END AS deployment_start_time,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS TIMESTAMP)
       ELSE TIMESTAMP '2024-01-26 00:00:00' END AS deployment_end_time
FROM {customer}
"""

GRID_SQL = """
SELECT core_id, deployment_start_time AS start_time, deployment_end_time AS end_time,
  CONCAT('T', CAST((core_id * 7) % 60 AS VARCHAR(8))) AS transformer,
  CONCAT(CASE (core_id * 7) % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'B' ELSE '' END,
         CAST((core_id * 7) % 12 AS VARCHAR(8))) AS feeder
FROM {deployment}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READINGS_SQL, events=table(spark, sf_dir, "events"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DEPLOYMENT_SQL, customer=table(spark, sf_dir, "customer"))


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GRID_SQL, deployment=deployments(spark, sf_dir))
