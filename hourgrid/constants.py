"""Fixed values of the domain. They must equal the published ones for results to agree."""

from __future__ import annotations

# Pollutants, their parameter codes, units and inclusive physical bounds.
POLLUTANTS = ("pm25", "no2", "ozone")
PARAMETER_CODES = {"88101": "pm25", "42602": "no2", "44201": "ozone"}
LIVE_PARAMETERS = {"pm25": "PM2.5", "no2": "NO2", "ozone": "OZONE"}
UNITS = {"pm25": "µg/m³", "no2": "ppb", "ozone": "ppm"}
BOUNDS = {"pm25": (0.0, 2000.0), "no2": (0.0, 500.0), "ozone": (0.0, 0.6)}

# Cleaning thresholds.
GAP_LIMIT_HOURS = 3
DRIFT_Z = 3.5
DRIFT_WINDOW_HOURS = 168
DRIFT_MIN_READINGS = 24

# Feature order, as the models expect it.
WEATHER_COLUMNS = ("temperature_2m", "wind_speed_10m", "relative_humidity_2m")
BASE_FEATURES = (
    "lag_1h", "lag_24h", "lag_168h",
    "roll_24h_mean", "roll_24h_std", "roll_168h_mean", "roll_168h_std",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "season", "latitude", "longitude", "drift_flag",
)
FEATURES = BASE_FEATURES + WEATHER_COLUMNS
READING_FEATURES = BASE_FEATURES[:7]
ESSENTIAL_LAGS = ("lag_1h", "lag_24h")
MIN_READINGS = 200
HORIZON_HOURS = 24

# Split, audit and ablation thresholds.
TEST_FRACTION = 0.2
FLAG_RATIO = 1.5
CHANGE_THRESHOLD = 0.005
MODEL_NAMES = ("GradientBoosting", "RandomForest", "ARIMA")
REQUEST_MODELS = ("GradientBoosting", "RandomForest")

# Live window and bounding box half sizes in degrees.
HISTORY_HOURS = 170
BOX_LATITUDE = 0.15
BOX_LONGITUDE = 0.18

# Ingest expectations.
ROWS_PER_STATION_YEAR = 8760
PULL_TARGET_ROWS = 500_000
NO_DATA_PHRASES = ("no data", "no matching data", "no results")

# Category bands, ascending upper limits (inclusive).
CATEGORY_LABELS = ("Good", "Moderate", "USG", "Unhealthy", "Very Unhealthy")
CATEGORY_LIMITS = {
    "pm25": (12.0, 35.4, 55.4, 150.4, 250.4),
    "no2": (53.0, 100.0, 360.0, 649.0, 1249.0),
    "ozone": (0.054, 0.070, 0.085, 0.105, 0.200),
}
ABOVE_ALL_LABEL = "Hazardous"
NO_DATA_LABEL = "No Data"
CATEGORY_ORDER = CATEGORY_LABELS + (ABOVE_ALL_LABEL, NO_DATA_LABEL)

# Census regions and their states.
CENSUS_REGIONS = {
    "Northeast": (
        "Connecticut", "Maine", "Massachusetts", "New Hampshire", "New Jersey", "New York",
        "Pennsylvania", "Rhode Island", "Vermont",
    ),
    "Midwest": (
        "Illinois", "Indiana", "Iowa", "Kansas", "Michigan", "Minnesota", "Missouri", "Nebraska",
        "North Dakota", "Ohio", "South Dakota", "Wisconsin",
    ),
    "South": (
        "Alabama", "Arkansas", "Delaware", "Florida", "Georgia", "Kentucky", "Louisiana", "Maryland",
        "Mississippi", "North Carolina", "Oklahoma", "South Carolina", "Tennessee", "Texas",
        "Virginia", "West Virginia",
    ),
    "West": (
        "Alaska", "Arizona", "California", "Colorado", "Hawaii", "Idaho", "Montana", "Nevada",
        "New Mexico", "Oregon", "Utah", "Washington", "Wyoming",
    ),
}
UNKNOWN_REGION = "Unknown"
