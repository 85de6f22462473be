"""The common benchmark tables seen as a fleet's stored tables.

Only column expressions and one aggregation (production) are used, so each
adapter reads its table once and keeps filters and pruning intact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.functions import half_up, level
from plantpulse.functions.keys import incident_key, order_key, padded

# Fixed values of the mapping
FLEET_SIZE = 25
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SIGNAL_OF_EVENT = (
    ("click", "VIBRATION"),
    ("view", "TEMPERATURE"),
    ("purchase", "CURRENT"),
    ("signup", "RPM"),
    ("error", "PRESSURE"),
)
UNITS = {"VIBRATION": "mm/s", "CURRENT": "A", "RPM": "rpm", "PRESSURE": "bar"}
WARNING, CRITICAL = 80.0, 150.0
MODE_OF_PRIORITY = (
    ("1-URGENT", "BEARING_DEGRADATION"),
    ("2-HIGH", "MISALIGNMENT"),
    ("3-MEDIUM", "OVERHEATING"),
    ("4-NOT SPECIFIED", "NONE"),
    ("5-LOW", "HYDRAULIC_SEAL_FAILURE"),
)
EVENT_TYPES = ("STARTUP", "SHUTDOWN", "STATE_CHANGE", "FAULT", "ALARM")
OBSERVATIONS = ("NOISE", "VIBRATION", "SMELL", "VISUAL", "LEAK", "OTHER")
CRITICALITIES = ("HIGH", "MEDIUM", "LOW")
SHIFTS = ("DAY", "SWING", "NIGHT")


def machine_key(number: Column) -> Column:
    return F.concat(F.lit("M"), padded(number % FLEET_SIZE, 3))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _recode(value: Column, pairs) -> Column:
    out = F.lit(None).cast("string")
    for code, name in reversed(pairs):
        out = F.when(value == code, F.lit(name)).otherwise(out)
    return out


class SharedTables:
    """Adapters over one directory of benchmark parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._opened: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A table; its footer is read for the schema once."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._opened[name]

    def machines(self) -> DataFrame:
        n = F.col("n_nationkey")
        joined = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return joined.select(
            machine_key(n).alias("machine_id"),
            F.col("n_name").alias("machine_name"),
            _pick(TYPES, n % 6).alias("machine_type"),
            F.col("r_name").alias("line"),
            F.concat(F.lit("ST-"), (n % 7).cast("string")).alias("station"),
            F.concat(F.lit("HALL-"), (n % 3).cast("string")).alias("location"),
            F.when(n % 8 != 7, F.lit(80.0)).alias("rated_rpm"),
            F.when(n % 9 == 8, F.lit(0.0)).otherwise(60.0).alias("rated_current"),
            _pick(CRITICALITIES, n % 3).alias("criticality"),
            F.when(n % 10 == 9, F.lit("MAINTENANCE")).otherwise(F.lit("RUNNING"))
            .alias("operating_state"),
        )

    def supplier_machines(self) -> DataFrame:
        """A registry that grows with the data: one machine per supplier."""
        s = F.col("s_suppkey")
        joined = (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return joined.select(
            F.concat(F.lit("S"), padded(s, 8)).alias("machine_id"),
            F.col("s_name").alias("machine_name"),
            _pick(TYPES, s % 6).alias("machine_type"),
            F.col("r_name").alias("line"),
            _pick(CRITICALITIES, s % 3).alias("criticality"),
        )

    def sensors(self) -> DataFrame:
        signals = F.explode(F.array(*[F.lit(signal) for _, signal in SIGNAL_OF_EVENT]))
        each = self.machines().select("machine_id", signals.alias("signal_type"))
        number = F.substring("machine_id", 2, 10).cast("int")
        unit = F.when(number % 2 == 0, F.lit("F")).otherwise(F.lit("C"))
        for signal, name in UNITS.items():
            unit = F.when(F.col("signal_type") == signal, F.lit(name)).otherwise(unit)
        limited = F.col("signal_type") != "RPM"
        return each.select(
            F.concat_ws("-", "machine_id", "signal_type").alias("sensor_id"),
            "machine_id",
            "signal_type",
            unit.alias("unit"),
            F.when(limited, F.lit(WARNING)).alias("warning_threshold"),
            F.when(limited, F.lit(CRITICAL)).alias("critical_threshold"),
            F.lit(43200).cast("long").alias("sampling_interval_sec"),
        )

    @staticmethod
    def _coded(events: DataFrame) -> DataFrame:
        """Events with their number and machine worked out once per row."""
        return events.select(
            "event_id", "ts", "event_type", "value", "user_id",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            machine_key(F.col("user_id")).alias("machine_id"),
            _recode(F.col("event_type"), SIGNAL_OF_EVENT).alias("signal_type"),
        )

    def readings_from(self, events: DataFrame) -> DataFrame:
        k = F.col("k")
        return self._coded(events).select(
            F.col("event_id").alias("reading_id"),
            F.concat_ws("-", "machine_id", "signal_type").alias("sensor_id"),
            "machine_id",
            "signal_type",
            F.when(k != 99, F.col("value")).alias("reading_value"),
            F.col("ts").alias("reading_timestamp"),
            F.when(k < 2, F.lit("SUSPECT")).when(k == 2, F.lit("STALE"))
            .otherwise(F.lit("GOOD")).alias("quality_flag"),
        )

    def sensor_readings(self) -> DataFrame:
        return self.readings_from(self.raw("events"))

    def machine_event_logs(self) -> DataFrame:
        k = F.col("k")
        kind = _pick(EVENT_TYPES, k % 5)
        return (
            self._coded(self.raw("events").where(F.col("event_type") == "error"))
            .select(
                "event_id",
                "machine_id",
                kind.alias("event_type"),
                F.when(kind != "STATE_CHANGE", F.concat(F.lit("EV-"), (k % 7).cast("string")))
                .when(k % 2 == 0, F.lit("SC-HIGHLOAD"))
                .otherwise(F.lit("SC-NORMAL")).alias("event_code"),
                level(F.col("value"), ((CRITICAL, "CRITICAL"), (WARNING, "WARNING")), "INFO")
                .alias("severity"),
                F.col("ts").alias("event_timestamp"),
            )
        )

    def shift_logs(self) -> DataFrame:
        k = F.col("k")
        hour = F.hour("ts")
        return (
            self._coded(self.raw("events").where(F.col("event_type") == "signup"))
            .select(
                F.col("event_id").alias("log_id"),
                "machine_id",
                F.concat(F.lit("OP-"), (F.col("user_id") % 9).cast("string")).alias("operator_id"),
                F.when((hour >= 6) & (hour < 14), F.lit("DAY"))
                .when((hour >= 14) & (hour < 22), F.lit("SWING"))
                .otherwise(F.lit("NIGHT")).alias("shift"),
                _pick(OBSERVATIONS, k % 6).alias("observation_type"),
                F.concat(F.lit("Observation number "), k.cast("string"))
                .alias("observation_detail"),
                level(F.col("value"), ((CRITICAL, "HIGH"), (WARNING, "MEDIUM")), "LOW")
                .alias("severity"),
                F.col("ts").alias("observed_at"),
            )
        )

    def maintenance_history(self) -> DataFrame:
        o = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.concat(F.lit("MH-"), padded(o, 9)).alias("maintenance_id"),
            machine_key(F.col("o_custkey")).alias("machine_id"),
            _recode(F.col("o_orderpriority"), MODE_OF_PRIORITY).alias("failure_mode"),
            F.concat(F.lit("Cause "), (o % 11).cast("string")).alias("root_cause"),
            F.concat(F.lit("Action "), (o % 7).cast("string")).alias("action_taken"),
            F.concat(F.lit("Part "), (o % 5).cast("string")).alias("parts_replaced"),
            ((o % 8).cast("double") + 0.5).alias("repair_duration_hrs"),
            (o % 12).cast("double").alias("downtime_hrs"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("cost"),
            F.when(status == "F", F.lit("CORRECTIVE")).when(status == "O", F.lit("PREVENTIVE"))
            .otherwise(F.lit("INSPECTION")).alias("maintenance_type"),
            F.col("o_orderdate").alias("started_at"),
            F.when(~((status == "P") & (o % 400 == 0)), F.col("o_orderdate"))
            .alias("completed_at"),
        )

    def parts_inventory(self) -> DataFrame:
        following = _recode(F.col("p_type"), tuple(zip(TYPES, TYPES[1:] + TYPES[:1])))
        return self.raw("part").select(
            F.concat(F.lit("P"), padded(F.col("p_partkey"), 9)).alias("part_id"),
            F.col("p_name").alias("part_name"),
            F.col("p_brand").alias("part_category"),
            F.concat_ws(",", "p_type", following).alias("compatible_machine_types"),
            (F.col("p_size") % 4).cast("long").alias("quantity_on_hand"),
            F.col("p_size").cast("long").alias("lead_time_days"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("unit_cost"),
        )

    def production_counts(self) -> DataFrame:
        """Production before good units and deviation are derived."""
        day = F.col("l_shipdate").cast("date")
        monday = F.date_sub(day, F.weekday(day))
        grouped = (
            self.raw("lineitem")
            .groupBy(
                (F.col("l_suppkey") % FLEET_SIZE).alias("m"),
                (F.col("l_linenumber") % 3).alias("s"),
                monday.alias("production_date"),
            )
            .agg(
                F.count("*").alias("n"),
                F.sum("l_quantity").alias("units"),
                F.sum(F.col("l_quantity") * F.col("l_discount")).alias("lost"),
                F.avg("l_tax").alias("idle"),
            )
        )
        actual = F.col("units").cast("long")
        rejected = F.floor(F.col("lost") + 1e-6).cast("long")
        downtime = half_up(F.col("idle") * 8, 2)
        ideal = half_up(F.lit(28800.0) / (F.col("n") * 50), 2)
        return grouped.select(
            machine_key(F.col("m")).alias("machine_id"),
            _pick(SHIFTS, F.col("s")).alias("shift"),
            "production_date",
            (F.col("n") * 50).cast("long").alias("planned_units"),
            actual.alias("actual_units"),
            rejected.alias("rejected_units"),
            half_up(ideal * 1.1, 2).alias("cycle_time_sec"),
            ideal.alias("ideal_cycle_time_sec"),
            F.lit(8.0).alias("planned_runtime_hrs"),
            half_up(8 - downtime, 2).alias("actual_runtime_hrs"),
            downtime.alias("downtime_hrs"),
            F.when(rejected * 100 > actual * 6, F.lit("DEGRADED")).otherwise(F.lit("NORMAL"))
            .alias("production_status"),
        )

    def production_quality(self) -> DataFrame:
        from plantpulse.operators.preparation import derive_quality

        return derive_quality(self.production_counts())

    def work_orders(self) -> DataFrame:
        """Past orders are resolved; one in a hundred each is draft, approved, assigned or rejected."""
        o = F.col("o_orderkey")
        stage = o % 100
        status = (
            F.when(stage == 0, F.lit("DRAFT")).when(stage == 1, F.lit("APPROVED"))
            .when(stage == 2, F.lit("ASSIGNED")).when(stage == 3, F.lit("REJECTED"))
            .otherwise(F.lit("RESOLVED"))
        )
        no_text = F.lit(None).cast("string")
        no_time = F.lit(None).cast("timestamp_ntz")
        return self.raw("orders").select(
            order_key(o).alias("work_order_id"),
            incident_key(o % 200 + 1).alias("incident_id"),
            machine_key(F.col("o_custkey")).alias("machine_id"),
            status.alias("status"),
            _pick(("CRITICAL", "HIGH", "MEDIUM"), o % 3).alias("priority"),
            F.concat(F.lit("Problem "), (o % 13).cast("string")).alias("problem_description"),
            _recode(F.col("o_orderpriority"), MODE_OF_PRIORITY).alias("predicted_failure_mode"),
            F.concat(F.lit("Step "), (o % 7).cast("string")).alias("recommended_actions"),
            ((o % 9).cast("double") + 0.5).alias("estimated_repair_hrs"),
            ((o % 14).cast("double") + 1.0).alias("estimated_downtime_hrs"),
            F.concat(F.lit("TECH-"), (o % 6).cast("string")).alias("assigned_technician"),
            no_text.alias("approved_by"),
            no_time.alias("approved_at"),
            no_text.alias("actual_root_cause"),
            no_text.alias("actual_parts_replaced"),
            F.lit(None).cast("double").alias("actual_repair_hrs"),
            no_text.alias("technician_findings"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            no_time.alias("resolved_at"),
        )

    def stream(self, name: str) -> DataFrame:
        """One of the tables as a stream of files."""
        return (
            self.spark.readStream.schema(self.raw(name).schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.sf_dir)
        )

    def approval_commands(self, orders: DataFrame | None = None) -> DataFrame:
        """A decision for every order, a second one for some; invalid actions and unknown orders included."""
        o = F.col("o_orderkey")
        known = F.when(o % 97 == 5, F.concat(F.lit("WO-X"), o.cast("string")))
        turns = F.explode(F.when(o % 200 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        action = _pick(("APPROVE", "REJECT", "ESCALATE"), (o / 100).cast("long") % 3)
        return (
            (self.raw("orders") if orders is None else orders)
            .select("o_orderkey", "o_custkey", turns.alias("turn"))
            .select(
                (o * 2 + F.col("turn")).alias("command_seq"),
                F.coalesce(known, order_key(o)).alias("work_order_id"),
                F.concat(F.lit("APPROVER-"), (F.col("o_custkey") % 5).cast("string"))
                .alias("approver"),
                F.when(F.col("turn") == 1, F.lit("APPROVE")).otherwise(action).alias("action"),
            )
        )

    def resolution_commands(self) -> DataFrame:
        o = F.col("o_orderkey")
        return (
            self.raw("orders")
            .select(
                o.alias("command_seq"),
                F.when(o % 97 == 5, F.concat(F.lit("WO-X"), o.cast("string")))
                .otherwise(order_key(o)).alias("work_order_id"),
                F.concat(F.lit("Cause "), (o % 11).cast("string")).alias("root_cause"),
                F.concat(F.lit("Part "), (o % 5).cast("string")).alias("parts"),
                ((o % 8).cast("double") + 0.5).alias("hours"),
                F.concat(F.lit("Finding "), (o % 4).cast("string")).alias("findings"),
            )
        )

    def triage_commands(self) -> DataFrame:
        o = F.col("o_orderkey")
        return (
            self.raw("orders")
            .select(
                o.alias("command_seq"),
                incident_key((o / 3).cast("long") % 50 + 1).alias("incident_id"),
                F.when(F.col("o_orderstatus") == "F", F.lit("ACKNOWLEDGE"))
                .otherwise(F.lit("FALSE_POSITIVE")).alias("action"),
            )
        )

    def lifecycle_commands(self) -> DataFrame:
        """A history of commands on incidents, by order number; unknown actions and incidents included."""
        o = F.col("o_orderkey")
        actions = ("ACKNOWLEDGE", "ASSIGN", "SNOOZE", "REQUEST_ORDER", "ESCALATE", "RESOLVE", "FALSE_POSITIVE", "REOPEN", "DANCE")
        return self.raw("orders").select(
            o.alias("command_seq"),
            incident_key((o / 3).cast("long") % 40 + 1).alias("incident_id"),
            _pick(actions, (o * 7 + F.col("o_custkey")) % 9).alias("action"),
            (F.lit("2024-01-23 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
                F.lit(0), F.lit(0), F.lit(0), ((o * 37) % 691200).cast("decimal(18,6)")
            )).alias("given_at"),
            F.concat(F.lit("TECH-"), (F.col("o_custkey") % 6).cast("string")).alias("owner"),
            F.concat(F.lit("Reason "), (o % 8).cast("string")).alias("reason"),
            ((o % 5) * 24).cast("int").alias("snooze_hours"),
        )
