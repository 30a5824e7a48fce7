"""Streaming forms of the hourly pipeline.

Windows and joins use built-in stateful operators; only recurrences keep explicit
keyed state, and fold it in event-time order (``ordered``), so the order in which files or
micro-batches arrive, a restart or a lost executor don't change the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.operators.filters import enrich_wind
from warmgrid.operators.sequential import ResidualScreen, SiteModel, SolarState
from warmgrid.streaming.ordered import OrderedFold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedupe(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Drop repeated site timestamps inside the lateness bound."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["site_id", "ts"])


def _hour_windows(samples: DataFrame, delay: str) -> DataFrame:
    s = enrich_wind(samples).withWatermark("ts", delay)
    return s.groupBy("site_id", F.window("ts", "1 hour")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("temp").alias("temp"), F.avg("humidity").alias("humidity"), F.avg("cloud_coverage").alias("cloud_coverage"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY effective_wind)").alias("effective_wind"),
        F.avg(F.col("aux_active").cast("double")).alias("aux_fraction"))


def stream_hourly_rollup(samples: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hours of minute samples; p90 wind as nearest rank over value counts."""
    return _hour_windows(samples, delay).select("site_id", F.col("window.start").alias("ts"), "sample_count", "temp", "humidity", "cloud_coverage", "effective_wind", "aux_fraction")


def stream_daily_rollup(samples: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Daily windows chained on the hourly ones (scalar columns), incomplete days flagged."""
    hours = _hour_windows(samples, delay)
    return hours.groupBy("site_id", F.window(F.window_time("window"), "1 day")).agg(
        F.count(F.lit(1)).alias("n_hours"), F.avg("temp").alias("temp"), F.sum("sample_count").alias("samples"),
    ).select("site_id", F.to_date("window.start").alias("local_date"), "n_hours", "temp", "samples", (F.col("n_hours") >= K.MIN_DAY_HOURS).alias("complete"))


SITE_BUCKETS = 256


def site_bucket(site="site_id"):
    """Folder bucket of a site: keeps a fleet's day folders few and of useful size."""
    return F.pmod(F.col(site), F.lit(SITE_BUCKETS)).cast("int")


def touched_days_writer(path: str, build):
    """foreachBatch body: rebuild and overwrite only the (site bucket, day) folders the batch touched.

    ``build(touched)`` recomputes every site of those folders from the stored hours, so
    unit maps and late hours come out right, and a replayed batch writes the same files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(site_bucket().alias("site_bucket"), "local_date").distinct()
        out = build(touched)
        # dynamic overwrite replaces only the folders present in this batch
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("local_date", "site_bucket").parquet(path)

    return write


def stream_forecast_join(hours: DataFrame, plan: DataFrame) -> DataFrame:
    """Each closed hour with its planned hour from a static snapshot."""
    p = plan.select("site_id", "ts", F.col("temperature").alias("plan_temp"), F.col("wind_speed").alias("plan_wind"))
    return hours.join(p, ["site_id", "ts"], "left").withColumn("temp_gap", F.col("temp") - F.col("plan_temp"))


def heating_sessions(readings: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Runs of activity of one unit and mode separated by a quiet gap."""
    return readings.withWatermark("ts", gap).groupBy("site_id", "unit_id", "mode", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("readings"), F.sum("value").alias("value")).select(
        "site_id", "unit_id", "mode", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "readings", "value")


def split_late(batch: DataFrame, horizon) -> tuple[DataFrame, DataFrame]:
    """On-time rows and late ones; late rows go to the correction table the batch jobs replay."""
    late = F.col("ts") < horizon
    return batch.filter(~late), batch.filter(late)


# --- keyed state ---------------------------------------------------------------------------


class MeterDelta(OrderedFold):
    """Cumulative readings to deltas; the last reading outlives restarts."""

    order = ["ts", "event_id"]
    output = "site_id long, unit_id string, event_id long, status string, delta_kwh double"

    def fold(self, key, doc, rows):
        reading = rows["reading_kwh"].to_numpy(float)
        raw = np.diff(reading, prepend=doc.get("last", np.nan))
        kinds = [("first", np.isnan(raw)), ("reset", raw < 0), ("spike", raw > K.MAX_ENERGY_DELTA), ("dhw", (rows["mode"] == "dhw").to_numpy())]
        status = np.select([test for _, test in kinds], [name for name, _ in kinds], "ok")
        doc["last"] = float(reading[-1])
        return pd.DataFrame({"site_id": key[0], "unit_id": key[1], "event_id": rows["event_id"], "status": status, "delta_kwh": np.where(status == "ok", raw, 0.0)})


class Battery(OrderedFold):
    """Stored solar heat after each hour."""

    output = "site_id long, ts timestamp, battery_state double"

    def fold(self, key, doc, rows):
        # an exponential mean whose first value is the state so far
        fed = pd.concat([pd.Series([doc.get("s", 0.0)]), rows["solar_impact_kwh"].astype(float).fillna(0.0)])
        after = fed.ewm(alpha=1 - K.BATTERY_DECAY, adjust=False).mean().to_numpy()[1:]
        doc["s"] = float(after[-1])
        return pd.DataFrame({"site_id": key[0], "ts": rows["ts"], "battery_state": after})


def cooldown_step(doc: dict, hour: int, aux: bool, actual: float, expected: float) -> bool:
    """Advance the post-aux lock by one hour; returns whether it was locked during that hour.

    Aux switching off starts it; it ends after six hours, or after two once the
    affected units draw 92 % of what is expected; aux switching on cancels it.
    """
    if aux and not doc.get("aux"):
        doc["since"] = None
    elif doc.get("aux") and not aux:
        doc["since"] = hour
    doc["aux"] = aux
    locked = doc.get("since") is not None
    if locked:
        elapsed = hour - doc["since"]
        near = expected > K.ENERGY_GUARD and actual / expected >= K.COOLDOWN_CONVERGENCE
        if elapsed >= K.COOLDOWN_MAX_HOURS or (elapsed >= K.COOLDOWN_MIN_HOURS and near):
            doc["since"] = None
    return locked


def cooldown_rows(site, doc: dict, rows: pd.DataFrame) -> pd.DataFrame:
    hours = (rows["ts"].astype("datetime64[s]").astype("int64") // 3600).tolist()
    locked = [cooldown_step(doc, h, bool(a), float(x), float(e)) for h, a, x, e in zip(hours, rows["auxiliary_active"], rows["actual_kwh"], rows["expected_kwh"])]
    return pd.DataFrame({"site_id": site, "ts": rows["ts"].to_numpy(), "locked": locked})


class Cooldown(OrderedFold):
    output = "site_id long, ts timestamp, locked boolean"

    def fold(self, key, doc, rows):
        return cooldown_rows(key[0], doc, rows)


def cooldown_inputs(hourly: DataFrame, hourly_unit: DataFrame, units: DataFrame) -> DataFrame:
    """Each logged hour with what its aux-affected units drew and their base; hours without such units have 0."""
    affected = units.where("aux_affected").select("site_id", "unit_id")
    drawn = hourly_unit.join(affected, ["site_id", "unit_id"], "left_semi").groupBy("site_id", "ts").agg(
        F.sum("actual_kwh").alias("actual_kwh"), F.sum("expected_base_kwh").alias("expected_kwh"))
    return hourly.select("site_id", "ts", "auxiliary_active").join(drawn, ["site_id", "ts"], "left").na.fill(0.0, ["actual_kwh", "expected_kwh"])


def cooldown_batch(hours: DataFrame) -> DataFrame:
    """Batch twin of the streaming lock, over ``cooldown_inputs``."""
    d = hours.select("site_id", F.col("ts").cast("timestamp").alias("ts"), "auxiliary_active", "actual_kwh", "expected_kwh")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return cooldown_rows(key[0], {}, pdf.sort_values("ts"))

    return d.groupBy("site_id").applyInPandas(run, Cooldown.output)


class SiteLearner(OrderedFold):
    """Hour-by-hour base and aux learning of a site; emits each hour's status."""

    output = "site_id long, ts timestamp, status string, cell_kwh double"

    def __init__(self, lr: float = K.LEARNING_RATE):
        self.lr = lr

    def fold(self, key, doc, rows):
        m, out = SiteModel(doc), []
        for r in rows.itertuples(index=False):
            status = m.hour(int(r.temp_key), r.wind_bucket, float(r.temp), float(r.energy), float(r.delta), float(r.weight), bool(r.auxiliary_active), bool(r.guest), self.lr)
            out.append((key[0], r.ts, status, m.base.get(str(int(r.temp_key)), {}).get(r.wind_bucket)))
        doc.update(m.dump())
        return pd.DataFrame(out, columns=["site_id", "ts", "status", "cell_kwh"])


class UnitSolarLearner(OrderedFold):
    """Residual screen and LMS / inequality updates of one unit and regime; a site's few units are one state."""

    together = True
    output = "site_id long, unit_id string, regime string, ts timestamp, outlier boolean, s double, e double, w double"

    def fold(self, key, doc, rows):
        st, scr = SolarState(3, doc.get("solar")), ResidualScreen(doc.get("screen"))
        numbers = lambda *cols: rows[list(cols)].to_numpy(float)
        sun, stored = numbers("ps", "pe", "pw"), numbers("battery_s", "battery_e", "battery_w")
        facts = numbers("raw_impact", "actual_kwh", "expected_base_kwh", "min_base").tolist()
        flags, coeffs = [], np.empty((len(rows), 3))
        for i, (off, (raw, actual, base, least)) in enumerate(zip(rows["is_shutdown"].tolist(), facts)):
            bad = scr.outlier(raw - float(st.coeff @ sun[i]), actual, base, least)
            if not bad and off and key[2] == "heating":
                st.shutdown(base, stored[i])
            elif not bad and not off:
                st.modulating(raw, sun[i])
            flags.append(bad)
            coeffs[i] = st.coeff
        doc.update({"solar": st.dump(), "screen": scr.dump()})
        named = dict(zip(["site_id", "unit_id", "regime"], key))
        return pd.DataFrame({**named, "ts": rows["ts"], "outlier": flags, "s": coeffs[:, 0], "e": coeffs[:, 1], "w": coeffs[:, 2]})


class OutageAlert(OrderedFold):
    """Sticky raise/clear over the latest 24 daylight hours; emits changes only."""

    output = "site_id long, ts timestamp, raised boolean, share double"

    def fold(self, key, doc, rows):
        last, raised, out = doc.get("last", []), doc.get("raised", False), []
        for r in rows.itertuples(index=False):
            if not (r.solar_factor or 0) > 0 or not r.dni_dhi_source:
                continue
            last = [*last, int(r.dni_dhi_source in ("native", "erbs_from_ghi"))][-K.OUTAGE_WINDOW:]
            if len(last) < K.OUTAGE_WINDOW:
                continue
            share = sum(last) / len(last)
            want = True if share < K.OUTAGE_RAISE_BELOW else False if share >= K.OUTAGE_CLEAR_AT else raised
            if want != raised:
                raised = want
                out.append((key[0], r.ts, raised, share))
        doc.update({"last": last, "raised": raised})
        return pd.DataFrame(out, columns=["site_id", "ts", "raised", "share"])
