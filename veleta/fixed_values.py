"""Fixed values that results depend on.

Every name list, bound, weight, lookup row and message text below is data that has to be
exactly as stated for results to agree; no logic lives here.
"""

# --- fixed values: observation schema -------------------------------------------------
SENSORS = [
    "temperature_c",
    "relative_humidity_pct",
    "pressure_hpa",
    "wind_speed_kmh",
    "rainfall_mm",
]
REQUIRED_COLUMNS = ["timestamp", "station_id", "latitude", "longitude", *SENSORS]
CLASSES = ["GENUINE_EXTREME", "NORMAL", "SENSOR_FAULT"]

# --- fixed values: bounds -------------------------------------------------------------
PHYSICAL_BOUNDS = {
    "temperature_c": (-20.0, 60.0),
    "relative_humidity_pct": (0.0, 100.0),
    "pressure_hpa": (700.0, 1084.0),
    "wind_speed_kmh": (0.0, 200.0),
    "rainfall_mm": (0.0, 500.0),
}
QC_BOUNDS = {
    "temperature_c": (-10.0, 60.0),
    "relative_humidity_pct": (0.0, 100.0),
    "pressure_hpa": (870.0, 1084.0),
    "wind_speed_kmh": (0.0, 200.0),
    "rainfall_mm": (0.0, 500.0),
}
QC_MAX_RATES = {
    "temperature_c": 5.0,
    "relative_humidity_pct": 30.0,
    "pressure_hpa": 10.0,
    "wind_speed_kmh": 40.0,
}
QC_MAX_DEVIATION = {"temperature_c": 4.0, "pressure_hpa": 15.0}
QC_ROBUST_Z_SENSORS = ["temperature_c", "relative_humidity_pct", "pressure_hpa"]
REQUEST_BOUNDS = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "temperature_c": (-25.0, 75.0),
    "relative_humidity_pct": (0.0, 100.0),
    "pressure_hpa": (680.0, 1084.0),
    "wind_speed_kmh": (0.0, 200.0),
    "rainfall_mm": (0.0, 500.0),
}
COUNTRY_BOX = {"latitude": (6.0, 38.0), "longitude": (65.0, 98.5)}

# --- fixed values: payload field names, in order of preference -------------------------
WRAPPER_KEYS = ["data", "stations", "observations", "records", "result", "aws_data", "items"]
SINGLE_RECORD_KEYS = ["id", "station_id", "station_code", "station", "temp", "curr_temp", "latitude", "lat"]
MISSING_TEXTS = [
    "", "na", "n/a", "null", "none", "-", "--", "nan", "nil", "missing",
    "-999", "-999.0", "-9999", "-9999.0", "9999", "9999.0", "-888", "-888.0",
]
MISSING_NUMBERS = [-999.0, -9999.0, 9999.0]
ALIASES = {
    "station_id": [
        "id", "station_code", "station_id", "stationid", "stn_id", "stnid", "wmo_id", "code", "sid",
    ],
    "station_name": [
        "station", "station_name", "stn_name", "stationname", "name", "location", "city", "place",
    ],
    "latitude": ["latitude", "lat", "lat_deg", "stn_lat", "latitude_deg"],
    "longitude": ["longitude", "lon", "lng", "long", "stn_lon", "longitude_deg"],
    "timestamp": [
        "timestamp", "time_stamp", "date_time", "datetime", "observed_at", "observation_time",
        "ist_time", "utc_time",
    ],
    "temperature_c": [
        "curr_temp", "temperature_c", "temperature", "temp", "temp_c", "today_max_temp",
        "today_min_temp", "max_temp", "min_temp", "ta", "air_temp", "dry_bulb", "t",
    ],
    "relative_humidity_pct": [
        "rh", "relative_humidity_pct", "relative_humidity_at_1730", "relative_humidity_at_0830",
        "relative_humidity", "humidity", "rh_pct", "rel_hum", "hum",
    ],
    "pressure_hpa": [
        "mslp", "pressure_hpa", "pressure", "pres", "slp", "station_pressure", "air_pressure",
        "barometer", "p",
    ],
    "wind_speed_kmh": [
        "wind_speed", "wind_speed_kmh", "wind_speed_ms", "wind_speed_mps", "wind_speed_knots", "ws",
        "wind_spd", "windspeed", "wspd", "wind",
    ],
    "rainfall_mm": [
        "rainfall", "rainfall_mm", "past_24_hrs_rainfall", "rainfall_cm", "rain_mm", "rain_cm",
        "precip_cm", "precipitation_cm", "rain", "rf", "precipitation", "precip", "cumulative_rain",
        "hourly_rain", "pr",
    ],
}
SENSOR_DEFAULTS = {
    "temperature_c": 25.0,
    "relative_humidity_pct": 50.0,
    "pressure_hpa": 1013.25,
    "wind_speed_kmh": 0.0,
    "rainfall_mm": 0.0,
}

# --- fixed values: coordinate recovery -------------------------------------------------
KNOWN_STATIONS = [("55D20BC6", 26.1175, 92.0835)]
REGIONS = [
    ("KAMRUP_METROPOLITAN", 26.1445, 91.7362),
    ("KAMRUP", 26.1445, 91.7362),
    ("ASSAM", 26.2006, 92.9376),
    ("GUWAHATI", 26.1445, 91.7362),
    ("KARBI_ANGLONG", 25.8495, 92.8816),
    ("DIMA_HASAO", 25.1910, 93.0181),
    ("DIBRUGARH", 27.4705, 94.9125),
    ("TINSUKIA", 27.4922, 95.3537),
    ("CACHAR", 24.8333, 92.8000),
    ("GOALPARA", 26.1594, 90.6292),
    ("BARPETA", 26.3200, 91.0000),
    ("DARRANG", 26.4328, 92.0283),
    ("MARIGAON", 26.2500, 92.3600),
    ("NAGAON", 26.3500, 92.6800),
    ("SONITPUR", 26.6500, 92.8000),
    ("JORHAT", 26.7500, 94.2200),
    ("SIVASAGAR", 26.9800, 94.6300),
    ("LAKHIMPUR", 27.2300, 94.1000),
    ("DHEMAJI", 27.4800, 94.5800),
    ("KOKRAJHAR", 26.4000, 90.2700),
    ("BONGAIGAON", 26.4800, 90.5600),
    ("CHIRANG", 26.5200, 90.5000),
    ("BAKSA", 26.6000, 91.5900),
    ("UDALGURI", 26.7322, 92.0939),
    ("HAILAKANDI", 24.6800, 92.5600),
    ("KARIMGANJ", 24.8700, 92.3500),
]
CENTRE = (20.5937, 78.9629)

# --- fixed values: English months ------------------------------------------------------
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]

# --- fixed values: model weights and scales --------------------------------------------
DETECTOR_WEIGHTS = {
    "isolation_forest": 0.25,
    "lof": 0.20,
    "one_class_svm": 0.20,
    "elliptic_envelope": 0.15,
    "mahalanobis": 0.10,
    "robust_zscore": 0.10,
}
DETECTOR_SHORT = {
    "isolation_forest": "if",
    "lof": "lof",
    "one_class_svm": "ocsvm",
    "elliptic_envelope": "elliptic",
    "mahalanobis": "mahalanobis",
    "robust_zscore": "robust_z",
}
EXPECTED_TARGETS = ["temperature_c", "relative_humidity_pct", "pressure_hpa"]
TARGET_SCALES = {"temperature_c": 5.0, "relative_humidity_pct": 15.0, "pressure_hpa": 6.0}
HEALTH_WEIGHTS = {
    "fault_rate": 0.40,
    "anomaly_rate": 0.20,
    "missing_rate": 0.15,
    "residual_score": 0.15,
    "noise_score": 0.10,
}
HEALTH_STATUS = [("HEALTHY", 80.0), ("NEEDS_ATTENTION", 50.0), ("DEGRADED", 20.0)]

# --- fixed values: result texts --------------------------------------------------------
ACTIONS = {
    "GENUINE_EXTREME": "Issue meteorological alert. Confirm radar and satellite ground truth.",
    "NORMAL": "Routine monitoring. Data quality verified.",
    "UNKNOWN": "Collect additional consecutive observations to resolve ambiguity.",
}
FAULT_ACTIONS = {
    "DRIFT": "Schedule calibration audit. Recalibrate sensor offset baseline.",
    "FREEZE": "Inspect transducer hardware for physical blockage or power stall.",
    "SPIKE": "Transient spike detected. Verify line noise or transient surge.",
    "COMMUNICATION_FAILURE": "Check telemetry modem, solar power budget, and cellular link.",
}
FAULT_ACTION_OTHER = "Inspect station telemetry and dispatch field maintenance if error persists."

TEXT_SPIKE = "Single-point extreme pressure excursion with immediate temporal recovery"
TEXT_SPIKE_RESIDUAL = "Pressure residual deviated by %+.2f hPa from expected value"
TEXT_FREEZE = "Near-zero variance across consecutive sensor observations (stuck value)"
TEXT_FREEZE_Z = "Relative humidity remained static while atmospheric baseline shifted"
TEXT_DRIFT = "Persistent directional deviation exceeding 2.0 robust MAD baselines"
TEXT_DRIFT_RESIDUAL = "Expected temperature residual steadily increased (%+.2f °C)"
TEXT_COMM = "Telemetry temporal gap (%.1f hours) indicates transmission dropout"
TEXT_QC_FAULT = "Severe statistical quality control violation (score: %.2f)"
TEXT_NO_FAULT = "No hardware fault signatures detected on active sensors"
TEXT_TEMP_Z = "Temperature baseline deviation: %+.2f MAD"
TEXT_RH_Z = "Relative humidity baseline deviation: %+.2f MAD"

TEXT_RAIN = [
    "Heavy convective downpour / storm precipitation (%.1f mm/hr)",
    "Moderate-to-heavy precipitation active (%.1f mm/hr)",
    "Precipitation active (%.1f mm)",
]
TEXT_WIND = [
    "Severe storm-force gale gusts (%.1f km/h)",
    "High convective wind gusts (%.1f km/h)",
    "Elevated atmospheric wind speed (%.1f km/h)",
]
TEXT_HEAT_SEVERE = "Severe heatwave conditions: extreme temperature (%.1f °C) with dry air mass (%.1f%%)"
TEXT_HEAT = "Heatwave threshold exceeded (%.1f °C)"
TEXT_COLD_SEVERE = "Severe cold wave conditions detected (%.1f °C)"
TEXT_COLD = "Cold wave threshold reached (%.1f °C)"
TEXT_MOIST = "Atmospheric moisture saturation consistent with rainstorm (RH: %.1f%%)"
TEXT_COOLING = "Convective downdraft evaporative cooling verified across sensors"
TEXT_LOW_PRESSURE = "Barometric low-pressure depression (%.1f hPa) aligns with storm activity"
TEXT_NEIGHBOURS = (
    "Nearby AWS stations confirm synchronized atmospheric pattern (spatial residual: %.2f)"
)
TEXT_NEIGHBOURS_SOME = "Moderate multi-station spatial agreement with neighboring AWS stations"
TEXT_FRONT = "Atmospheric front signature: temp drop (%+.1f °C) coupled with humidity surge (%+.1f%%)"
TEXT_PRESSURE_DROP = "Rapid barometric pressure drop (%+.1f hPa/hr)"
TEXT_NOT_FREEZE = "Frozen sensor telemetry strongly contradicts genuine meteorological event"
TEXT_NOT_SPIKE = "Single-point spike without neighbor co-occurrence contradicts physical weather"
TEXT_NOT_COMM = "Telemetry communication dropout indicates transmission failure"

TEXT_DETECTORS_EXTREME = "%d/%d anomaly detectors confirm significant atmospheric deviation"
TEXT_DETECTORS_FAULT = "%d/%d anomaly models flag statistical outlier"
TEXT_NORMAL_BASE = "All sensor observations within normal historical climatology baselines"
TEXT_NORMAL_QUIET = "Unsupervised anomaly detectors find no outlier evidence (0/6 consensus)"
TEXT_NORMAL_AGREE = "High cross-sensor regression and neighbor spatial agreement"
TEXT_UNKNOWN = "Conflicting evidence detected across anomaly and spatial engines"
TEXT_UNKNOWN_UNCERTAIN = "Model disagreement uncertainty is high (%.2f)"

TEXT_QC_BOUNDS = "{sensor} (%s) outside physical bounds [{low}, {high}]"
TEXT_QC_RATE = "{sensor} rate of change (%.2f) exceeds max allowed ({limit})"
TEXT_QC_DEVIATION = "{sensor} deviation from station baseline is %+.2f"
TEXT_QC_VOLATILITY = "Temperature rolling volatility is unusually high (%.2f °C)"
TEXT_QC_Z = "{sensor} robust Z-score is %+.2f"
TEXT_QC_SPIKE = "Single-point extreme spike detected followed by recovery"
TEXT_QC_FREEZE = "Near-zero variance across 3+ observations (frozen sensor)"
TEXT_QC_GAP = "Observation follows a temporal data gap of %.1f hours"
TEXT_QC_DUPLICATE = "Duplicate station timestamp detected"
TEXT_QC_CROSS = "Rainfall (%s mm) inconsistent with low humidity (%s%%)"
