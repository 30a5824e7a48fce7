"""Fixed values of the telemetry model.

Everything here is a constant the computed results depend on. Values are kept
together, in plain text, so a reader can audit them in one place.
"""

# --- fixed values: site defaults -------------------------------------------
BALANCE_POINT = 17.0
WIND_GUST_FACTOR = 0.6
HIGH_WIND = 8.0
EXTREME_WIND = 10.8
LEARNING_RATE = 0.01
DAILY_LEARNING_RATE = 0.005
MAX_ENERGY_DELTA = 3.0
INERTIA_HOURS = 4
SOLAR_AZIMUTH = 180.0
BATTERY_DECAY = 0.50
ENERGY_GUARD = 0.01
DEFAULT_CLOUD = 50.0

# --- fixed values: modes and buckets ---------------------------------------
HEATING_MODES = ("heating", "guest_heating")
COOLING_MODES = ("cooling", "guest_cooling")
EXCLUDED_MODES = ("off", "dhw", "guest_heating", "guest_cooling")
WIND_BUCKETS = ("normal", "high_wind", "extreme_wind")
COOLING_BUCKET = "cooling"

# --- fixed values: text sky conditions to cloud cover in percent ------------
CLOUD_BY_CONDITION = {
    "clear-night": 0,
    "sunny": 0,
    "partlycloudy": 50,
    "cloudy": 85,
    "rainy": 95,
    "pouring": 100,
    "fog": 100,
    "hail": 100,
    "lightning": 95,
    "lightning-rainy": 95,
    "snowy": 100,
    "snowy-rainy": 100,
    "windy": 50,
    "windy-variant": 50,
    "exceptional": 50,
}

# --- fixed values: speed units to m/s --------------------------------------
SPEED_UNITS = {
    "km/h": ("/", 3.6),
    "kmh": ("/", 3.6),
    "km/t": ("/", 3.6),
    "kph": ("/", 3.6),
    "mph": ("*", 0.44704),
    "kn": ("*", 0.514444),
    "kt": ("*", 0.514444),
    "knots": ("*", 0.514444),
}

# --- fixed values: regime, mixed-mode and interference shares ----------------
REGIME_DOMINANCE = 0.8
MIXED_LOW = 0.20
MIXED_HIGH = 0.80
DUAL_INTERFERENCE = 0.1
COOLDOWN_MIN_HOURS = 2
COOLDOWN_MAX_HOURS = 6
COOLDOWN_CONVERGENCE = 0.92

# --- fixed values: solar ----------------------------------------------------
SCREEN_FLOOR = 0.30
SHUTDOWN_ACTUAL_FLOOR = 0.03
SHUTDOWN_RATIO = 0.15
SHUTDOWN_MIN_BASE = 0.15
SHUTDOWN_MIN_MAGNITUDE = 0.3
SOLAR_COEFF_CAP = 5.0
SOLAR_COEFF_HEATING = 0.35
SOLAR_COEFF_COOLING = 0.40
NLMS_STEP = 0.10
NLMS_REGULARIZATION = 0.05
COLD_START_DAMPING = 0.75
DEAD_ZONE_HOURS = 15
INEQUALITY_STEP = 0.05
INEQUALITY_MARGIN = 0.9
SNR_FLOOR = 0.1
SNR_K = 3.0
BATCH_FIT_DAMPING = 0.3
SATURATION_RATIO = 0.95

# --- fixed values: learning buffers and folds --------------------------------
BUFFER_SIZE = 4
UNIT_RATE_CAP = 0.03
MIN_DAY_HOURS = 20
LEARN_DAY_HOURS = 22
MIN_DAY_TDD = 0.5
OUTLIER_WINDOW = 50
OUTLIER_SIGMA = 5.0
OUTLIER_MIN_SAMPLES = 20
OUTLIER_POOL = 20
OUTLIER_PROMOTION = 10
OUTLIER_CAP_FACTOR = 10.0

# --- fixed values: per-unit noise floor --------------------------------------
MIN_BASE_FLOOR = 0.03
MIN_BASE_CEILING = 1.5
MIN_BASE_SAMPLES = 20
MIN_BASE_LOG_HOURS = 336
MIN_BASE_RATE_LIMIT = 0.5
DARK_SOLAR_FACTOR = 0.05
MIN_BASE_P10_MEDIAN = 0.9

# --- fixed values: censored regression --------------------------------------
TOBIT_MIN_UNCENSORED = 20
TOBIT_MIN_NEFF = 40
TOBIT_MAX_ITER = 30
TOBIT_TOL = 1e-6
TOBIT_WINDOW = 200
PLAUSIBLE_MIN_OLS = 0.10
PLAUSIBLE_MIN_TOBIT = 0.05
PLAUSIBLE_MIN_COSINE = 0.5
PLAUSIBLE_STEP = 0.30

# --- fixed values: implied coefficients ---------------------------------------
IMPLIED_MAX_SPREAD = 3.0
IMPLIED_NEAR_ZERO = 0.05
IMPLIED_MIN_HOURS = 30

# --- fixed values: obstruction fit --------------------------------------------
OBSTRUCTION_SSE_GAIN = 0.30
OBSTRUCTION_LOW_RANGE = (2.0, 20.0)
OBSTRUCTION_HIGH_RANGE = (20.0, 60.0)
OBSTRUCTION_LOW_GRID = (5.0, 40.0)
OBSTRUCTION_HIGH_GRID = (15.0, 70.0)
OBSTRUCTION_STEP = 1.0
OBSTRUCTION_MIN_SIDE = 10
OBSTRUCTION_K_SIDE = 20
OBSTRUCTION_MAX_ANGLE = 25.0
OBSTRUCTION_WINDOWS = (30, 60, 90)
OBSTRUCTION_TOLERANCE = 3.0
OBSTRUCTION_MIN_AGREEING = 2
OBSTRUCTION_MIN_RMS = 0.05

# --- fixed values: deviation, confidence, forecast ----------------------------
DEVIATION_MIN_OBS = 5
DEVIATION_MIN_KWH = 0.2
DEVIATION_TOL_NEW = 0.75
DEVIATION_TOL_MATURE = 0.30
DEVIATION_MATURITY = 20.0
CONFIDENCE_MIN_SAMPLES = 7
CONFIDENCE_HIGH_SAMPLES = 14
CONFIDENCE_HIGH_ERROR = 2.0
CONFIDENCE_MEDIUM_ERROR = 4.0
COMPARISON_MARGIN = 0.9
UNCERTAINTY_P50 = 1.0
UNCERTAINTY_P95 = 2.0
CROSSOVER_DAY = 4
STRESS_BANDS = (30.0, 60.0, 90.0)
TYPICAL_TEMP_TOL = 1.0
TYPICAL_WIND_TOL = 2.0
TYPICAL_MIN_SAMPLES = 3
TYPICAL_HIGH_SAMPLES = 7

# --- fixed values: irradiance source health ------------------------------------
REAL_SOURCE_SHARE = 0.80
SOURCE_MIX_MIN_HOURS = 50
OUTAGE_WINDOW = 24
OUTAGE_RAISE_BELOW = 0.10
OUTAGE_CLEAR_AT = 0.50

# --- fixed values: thermodynamic smearing ---------------------------------------
WIND_LOSS_FACTOR = {"normal": 1.0, "high_wind": 1.3, "extreme_wind": 1.6}
DEFROST_FACTOR = 0.85
DEFROST_TEMP = 7.0
DEFROST_RH = 70.0
KELVIN = 273.15
MPC_MIN_HOURS = 18

# --- fixed values: weather-driver classes ---------------------------------------
TEMP_EXTREME = 5.0
TEMP_SIGNIFICANT = 2.5
TEMP_MODERATE = 1.0
WIND_RELEVANCE = 1.0
SOLAR_SIGNIFICANT = 2.0
SOLAR_MODERATE = 0.5
