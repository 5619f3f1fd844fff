"""Checks of a scenario's expectations against its definition and a run's results, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a key that is no expectation.
REMARK = "notes"
#: Fixed value: share by which an offset may miss what is expected.
OFFSET_TOLERANCE = 0.2


def checks(expected: DataFrame, packs: DataFrame, results: DataFrame) -> DataFrame:
    """mission, key, outcome (PASS, FAIL or SKIP) of each expectation but remarks.

    expected: mission, key, value (string). packs: mission, actors, fences, broadcast (arrays of strings: the identities
    that events send). results: mission, id_switches, reassoc_p, offset_m, reassoc_track_id, geofence_alerts (array); null
    where the run has none, which is a SKIP. Unknown keys are a SKIP, values that can't be read a FAIL. A mission has one row
    in packs and at most one in results.
    """
    names = expected.groupBy("mission").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_{k}") for k in ("dark_actor", "intrusion_fence")])
    d = expected.where(F.col("key") != REMARK).join(names, "mission").join(packs, "mission", "left").join(results, "mission", "left")
    value, number = F.col("value"), F.col("value").try_cast("double")
    none = F.array().cast("array<string>")
    actors, fences, sent = (F.coalesce(F.col(c), none) for c in ("actors", "fences", "broadcast"))
    verdict = lambda ok: F.when(ok, "PASS").otherwise("FAIL")

    def measured(result: str, ok: Column) -> Column:
        return F.when(F.col(result).isNull(), "SKIP").otherwise(verdict(F.coalesce(ok, F.lit(False))))

    truth = F.coalesce("_dark_actor", F.when(F.size(actors) == 1, actors[0]))
    alerts = F.col("geofence_alerts")
    wanted = F.lower(value).isin("true", "1", "yes")
    fired = F.when(~wanted, F.size(alerts) == 0).when(F.size(alerts) == 0, False).otherwise(F.col("_intrusion_fence").isNull() | F.array_contains(alerts, F.col("_intrusion_fence")))
    outcome = {
        "dark_actor": verdict(F.array_contains(actors, value)),
        "actors": verdict(F.size(F.array_except(F.split(value, ","), actors)) == 0),
        "intrusion_fence": verdict(F.array_contains(fences, value)),
        "spoof_mmsi": verdict(F.array_contains(sent, value)),
        "id_switches_max": measured("id_switches", F.col("id_switches") <= number),
        "reassoc_p_min": measured("reassoc_p", F.col("reassoc_p") >= number),
        "reassoc_correct": F.when(truth.isNull(), "SKIP").otherwise(measured("reassoc_track_id", F.col("reassoc_track_id") == truth)),
        "geofence_alert": measured("geofence_alerts", fired),
        "predicted_vs_true_offset_verified_m": measured("offset_m", F.abs(F.col("offset_m") - number) <= OFFSET_TOLERANCE * F.abs(number)),
    }
    chosen = F.lit("SKIP")
    for key, of in outcome.items():
        chosen = F.when(F.col("key") == key, of).otherwise(chosen)
    return d.select("mission", "key", chosen.alias("outcome"))
