"""Safety alarms: carbon monoxide latch, alert edges, trail output, lost frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latch, ordered
from . import tables as T
from .registry import query

BOOT = ["device_id", "boot_id"]

T.define("co_runs", ["co"], """SELECT *, max(CASE WHEN chg THEN t_s END) OVER (PARTITION BY device_id, boot_id ORDER BY t_s) AS run_start FROM (
    SELECT *, lag(band) OVER w IS DISTINCT FROM band AS chg FROM (SELECT *, CASE WHEN ppm IS NULL THEN 'x' WHEN ppm>=100 THEN 'A'
      WHEN ppm>=35 THEN 'W' WHEN ppm>=30 THEN 'm' ELSE 'C' END AS band FROM co) WINDOW w AS (PARTITION BY device_id, boot_id ORDER BY t_s))""")
T.define("co_levels", ["co_runs"], """SELECT *, CASE WHEN worst=2 THEN 'alarm' WHEN worst=1 THEN 'warning' ELSE 'none' END AS level FROM (
    SELECT *, max(CASE WHEN band='A' THEN 2 WHEN band='W' AND t_s-run_start>=180 THEN 1 ELSE 0 END)
      OVER (PARTITION BY device_id, boot_id, epoch ORDER BY t_s) AS worst FROM (
      SELECT *, sum(CASE WHEN band='C' AND t_s-run_start>=30 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, boot_id ORDER BY t_s) AS epoch FROM co_runs))""")


@query("co_alarm", T.ctes("co_levels") + " SELECT device_id, boot_id, t_s, ppm, level FROM co_levels")
def co_alarm(spark, d):
    out = latch.co_latch(T.co_readings(spark, d), BOOT)
    return out.select(*BOOT, "t_s", "ppm", "level")


@query("co_alarm_intervals", T.ctes("co_levels") + """ SELECT device_id, boot_id, level, run_start, max(t_s) AS run_end, count(*) AS n_rows FROM (
    SELECT *, max(CASE WHEN chg2 THEN t_s END) OVER (PARTITION BY device_id, boot_id ORDER BY t_s) AS run_start FROM (
      SELECT device_id, boot_id, t_s, level, lag(level) OVER (PARTITION BY device_id, boot_id ORDER BY t_s) IS DISTINCT FROM level AS chg2 FROM co_levels))
    WHERE level<>'none' GROUP BY device_id, boot_id, level, run_start""")
def co_alarm_intervals(spark, d):
    levels = latch.co_latch(T.co_readings(spark, d), BOOT)
    return latch.intervals(levels, BOOT, "t_s", "level").filter("level <> 'none'")
