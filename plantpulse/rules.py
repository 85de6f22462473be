"""Thresholds, vocabularies and texts.

Every value in this module is fixed: results only agree with the fleet's
established reports when they are exactly these. Operators take them as
defaults, so a caller can pass other ones.
"""

from __future__ import annotations

# --- Fixed values: vocabularies -------------------------------------------
SIGNALS = ("VIBRATION", "TEMPERATURE", "CURRENT", "RPM", "PRESSURE", "ACOUSTIC")
STATE_EVENTS = ("STARTUP", "SHUTDOWN", "STATE_CHANGE", "FAULT")
SUPPRESSED_STATES = ("OFFLINE", "MAINTENANCE")
HIGH_LOAD_CODE = "SC-HIGHLOAD"
CLOSED_ORDER_STATES = ("RESOLVED", "REJECTED")
NO_PREDICTION = "MONITORING"
NO_MODE = "NONE_DETECTED"

# --- Fixed values: reading checks ------------------------------------------
SPIKE_SIGMA = 3
SPIKE_LOOKBACK = 20
STALE_FACTOR = 3

# --- Fixed values: rolling frames over hourly rows -------------------------
SHORT_FRAME = 6
DAY_FRAME = 24
WEEK_FRAME = 168

# --- Fixed values: points taken off a signal's health ----------------------
# (measure, steps); the first limit exceeded counts
HEALTH_PENALTIES = (
    ("total_criticals_24h", ((0, 30),)),
    ("total_warnings_24h", ((3, 20), (0, 10))),
    ("latest_baseline_dev", ((3, 15),)),
    ("total_spikes_24h", ((5, 10), (0, 5))),
    ("total_bad_quality_24h", ((5, 10),)),
    ("latest_roc", ((2, 10),)),
)
HEALTH_BANDS = ((80, "HEALTHY"), (60, "WARNING"), (40, "DEGRADED"))
HEALTH_FLOOR = "CRITICAL"
AT_RISK_BELOW = 60

# --- Fixed values: points added to an anomaly ------------------------------
ANOMALY_POINTS = (
    ("critical_count", ((0, 40),)),
    ("warning_count", ((2, 20), (0, 10))),
    ("baseline_deviation_7d", ((5, 20), (3, 10))),
    ("rate_of_change_6h", ((3, 15), (1.5, 8))),
    ("spike_count", ((3, 10), (0, 5))),
)
ANOMALY_BANDS = ((60, "HIGH"), (35, "MEDIUM"), (15, "LOW"))
ANOMALY_KEEP = 15
ANOMALY_MODEL = "STATISTICAL_RULE_V1"
ANOMALY_MODEL_TEXT = (
    "Rule-based anomaly score from threshold breaches, baseline deviation, "
    "rate of change, and spike frequency"
)

# --- Fixed values: forecasts ------------------------------------------------
FORECAST_MODEL = "TREND_REGRESSION_V1"
TREND_RECENT_DAYS = 3
TREND_PRIOR_DAYS = (10, 7)
TREND_DIVISOR = 7
# (signal, direction, slope limit, failure mode); the first that holds counts
FAILURE_RULES = (
    ("VIBRATION", "rising", 0.2, "BEARING_DEGRADATION"),
    ("VIBRATION", "rising", 0.1, "MISALIGNMENT"),
    ("TEMPERATURE", "rising", 1.0, "OVERHEATING"),
    ("CURRENT", "rising", 0.5, "MOTOR_OVERLOAD"),
    ("PRESSURE", "falling", -1.0, "HYDRAULIC_SEAL_FAILURE"),
)
# (days at most, horizon)
RISK_HORIZONS = ((3, "24_HOUR"), (7, "7_DAY"), (30, "30_DAY"))
FAR_HORIZON = "BEYOND_30_DAY"
NO_HORIZON = "STABLE"
HORIZON_ORDER = ("24_HOUR", "7_DAY", "30_DAY", "BEYOND_30_DAY", "STABLE")
HIGH_CONFIDENCE_SLOPE = 0.3
# (slope limit, confidence)
CONFIDENCE_STEPS = ((0.1, "MEDIUM"), (0.05, "LOW"))
NO_CONFIDENCE = "INSUFFICIENT_DATA"
CONFIDENCE_ORDER = ("HIGH", "MEDIUM", "LOW", "INSUFFICIENT_DATA")
UNSET_WARNING = 99999

# --- Fixed values: assessments ----------------------------------------------
EVIDENCE_SIGNALS = (
    ("vib", "VIBRATION"),
    ("temp", "TEMPERATURE"),
    ("curr", "CURRENT"),
    ("press", "PRESSURE"),
)
IMMEDIATE_DAYS = 3
SCHEDULE_DAYS = 7
RECOMMENDATIONS = (
    "IMMEDIATE_ACTION_REQUIRED",
    "SCHEDULE_MAINTENANCE",
    "MONITOR_CLOSELY",
    "ROUTINE_MONITORING",
)
INCIDENT_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")
REPORTED_SEVERITIES = ("MEDIUM", "HIGH")

# --- Fixed values: priority -------------------------------------------------
HEALTH_WEIGHT = 0.3
UNKNOWN_HEALTH = 50
CRITICALITY_POINTS = {"HIGH": 20, "MEDIUM": 10}
OTHER_CRITICALITY_POINTS = 5
DEGRADED_POINTS = 20
REJECT_STEPS = ((5, 15), (3, 10))
# (days at most, points)
URGENCY_STEPS = ((1, 20), (3, 15), (7, 10))
CONFIDENCE_POINTS = {"HIGH": 10, "MEDIUM": 5}

# --- Fixed values: work orders ----------------------------------------------
# failure mode -> (actions, repair hours, downtime hours); None is every other mode
ACTION_TEMPLATES = (
    ("BEARING_DEGRADATION",
     "1. Isolate machine 2. Inspect bearings 3. Check lubrication 4. Replace if worn 5. Realign 6. Test",
     6.0, 8.0),
    ("MISALIGNMENT",
     "1. Stop machine 2. Laser alignment 3. Inspect coupling 4. Realign 5. Replace coupling if needed 6. Test",
     8.0, 12.0),
    ("HYDRAULIC_SEAL_FAILURE",
     "1. Depressurize 2. Inspect seals 3. Check fluid 4. Replace seals+filter 5. Flush 6. Pressure test",
     5.0, 7.0),
    ("OVERHEATING",
     "1. Check cooling 2. Inspect airflow 3. Check bearings 4. Verify load 5. Clean exchangers",
     4.0, 6.0),
    (None, "1. Inspect 2. Document 3. Determine corrective action", 4.0, 6.0),
)
# severity -> window; None is every other severity
ORDER_WINDOWS = (
    ("CRITICAL", "IMMEDIATE - Next shift"),
    ("HIGH", "URGENT - Within 48 hours"),
    (None, "PLANNED - Next maintenance window"),
)
ORDER_STAGES = ("DRAFT", "APPROVED", "ASSIGNED", "IN_PROGRESS")
NOTIFIED_SEVERITIES = ("CRITICAL", "HIGH")
NOTICE_LENGTH = 500

# --- Fixed values: production ------------------------------------------------
OEE_DAYS = 7
SHIFT_HOURS = 8.0
DEFAULT_RUL_DAYS = 7
SHIFT_ORDER = ("DAY", "SWING", "NIGHT")

# --- Fixed values: the sensor catalogue --------------------------------------
# (signal, unit, min, max, warning, critical)
CORE_SIGNALS = (
    ("VIBRATION", "mm/s", 0.0, 20.0, 7.0, 12.0),
    ("TEMPERATURE", "C", 10.0, 120.0, 75.0, 95.0),
    ("CURRENT", "A", 0.0, 150.0, None, None),
    ("RPM", "rpm", 0.0, 6000.0, None, None),
)
PRESSURE_SIGNAL = ("PRESSURE", "bar", 0.0, 300.0, 220.0, 260.0)
ACOUSTIC_SIGNAL = ("ACOUSTIC", "dB", 30.0, 110.0, 85.0, 95.0)
DEFAULT_INTERVAL_SEC = 60

# --- Fixed values: the life of an incident -----------------------------------
# states in order, and for each action where it leads from the states that allow it
INCIDENT_STATES = ("NEW", "ACKNOWLEDGED", "ASSIGNED", "WORK_ORDER_PENDING", "RESOLVED", "FALSE_POSITIVE")
CLOSED_INCIDENT_STATES = ("RESOLVED", "FALSE_POSITIVE")
INCIDENT_MOVES = {
    "ACKNOWLEDGE": {"NEW": "ACKNOWLEDGED"},
    "ASSIGN": {"NEW": "ASSIGNED", "ACKNOWLEDGED": "ASSIGNED", "ASSIGNED": "ASSIGNED"},
    "REQUEST_ORDER": {"ACKNOWLEDGED": "WORK_ORDER_PENDING", "ASSIGNED": "WORK_ORDER_PENDING"},
    "SNOOZE": {"NEW": "NEW", "ACKNOWLEDGED": "ACKNOWLEDGED", "ASSIGNED": "ASSIGNED"},
    "ESCALATE": {
        "NEW": "NEW", "ACKNOWLEDGED": "ACKNOWLEDGED", "ASSIGNED": "ASSIGNED", "WORK_ORDER_PENDING": "WORK_ORDER_PENDING",
    },
    "RESOLVE": {"ACKNOWLEDGED": "RESOLVED", "ASSIGNED": "RESOLVED", "WORK_ORDER_PENDING": "RESOLVED"},
    "FALSE_POSITIVE": {"NEW": "FALSE_POSITIVE", "ACKNOWLEDGED": "FALSE_POSITIVE", "ASSIGNED": "FALSE_POSITIVE"},
    "REOPEN": {"RESOLVED": "NEW", "FALSE_POSITIVE": "NEW"},
}
