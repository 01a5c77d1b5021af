"""Column names, rule tables and feature lists shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("station",)
TIME = "time"
SEQ = "seq"

# ---------------------------------------------------------------------------
# Names, thresholds and tables that results must agree with.
# ---------------------------------------------------------------------------

MEASURES = [
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction",
    "carbon_monoxide", "no", "nitrogen_dioxide", "ozone", "sulphur_dioxide",
    "pm2_5", "pm10", "nh3",
]

RAW_COLUMNS = MEASURES + [
    "openweather_aqi", "pm2_5_aqi", "pm10_aqi", "us_aqi", "city", "latitude", "longitude",
]

POLLUTANT_NAMES = {
    "co": "carbon_monoxide",
    "no2": "nitrogen_dioxide",
    "o3": "ozone",
    "so2": "sulphur_dioxide",
}

STATIC_COLUMNS = [
    "city", "latitude", "longitude",
    "hour", "day", "month", "year", "day_of_week", "day_of_year", "week_of_year",
]
VALIDATION_COLUMNS = ["iqair_aqi", "abs_deviation"]
TARGETS = ["pm2_5", "pm10"]

LAG_HOURS = [1, 2, 3, 6, 12, 24, 48, 72]
ROLLING_HOURS = [3, 6, 12, 24]
ROLLING_STATS = ["mean", "std", "min", "max"]
CHANGE_HOURS = [1, 6, 24]
# minutes either side of the lagged instant; every other lag uses 60
LAG_TOLERANCE_MINUTES = {1: 30, 2: 45, 3: 50}

IQR_COLUMNS = ["pm2_5", "pm10", "carbon_monoxide", "ozone", "sulphur_dioxide", "nh3"]

FLAG_COLUMNS = [
    "is_spring", "is_summer", "is_autumn", "is_winter", "is_night",
    "is_morning_rush", "is_evening_rush", "is_hot", "is_cold",
    "is_high_humidity", "is_low_humidity", "is_high_wind", "is_calm",
    "is_low_pressure", "is_high_pressure", "is_high_pm2_5", "is_low_pm2_5",
    "is_high_pm10", "is_low_pm10", "is_high_no2", "is_high_o3",
    "is_high_co", "is_high_so2",
]

CYCLIC_COLUMNS = [
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
]

CLEAN_FEATURES = [
    "time", "time_str",
    "pm2_5", "pm10", "carbon_monoxide", "ozone", "sulphur_dioxide", "nh3",
    "us_aqi",
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction",
    "wind_direction_sin", "wind_direction_cos", "is_wind_from_high_pm", "is_wind_from_low_pm",
    "pm2_5_lag_1h", "pm2_5_lag_2h", "pm2_5_lag_3h", "pm2_5_lag_24h",
    "pm10_lag_1h", "pm10_lag_2h", "pm10_lag_3h", "pm10_lag_24h",
    "co_lag_1h", "o3_lag_1h", "so2_lag_1h",
    "temp_lag_1h", "wind_speed_lag_1h", "humidity_lag_1h", "pressure_lag_1h",
    "ozone_lag_3h",
    "pm2_5_rolling_min_3h", "pm2_5_rolling_mean_3h", "pm2_5_rolling_max_3h",
    "pm2_5_rolling_min_12h", "pm2_5_rolling_mean_12h", "pm2_5_rolling_max_12h",
    "pm2_5_rolling_mean_24h", "pm2_5_rolling_max_24h",
    "pm10_rolling_min_3h", "pm10_rolling_mean_3h", "pm10_rolling_mean_12h", "pm10_rolling_mean_24h",
    "temp_rolling_mean_3h", "humidity_rolling_mean_3h",
    "wind_speed_rolling_mean_3h", "pressure_rolling_mean_3h",
    "temp_rolling_mean_12h", "humidity_rolling_mean_12h",
    "wind_speed_rolling_mean_12h", "pressure_rolling_mean_12h",
    "ozone_rolling_mean_3h", "ozone_rolling_mean_12h",
    "pm2_5_change_rate_1h", "pm2_5_change_rate_6h", "pm2_5_change_rate_24h",
    "pm10_change_rate_1h", "pm10_change_rate_6h", "pm10_change_rate_24h",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
    "is_hot", "is_night", "is_morning_rush", "is_evening_rush", "is_high_pm2_5", "is_high_o3",
    "temp_humidity_interaction", "temp_wind_interaction", "wind_direction_temp_interaction",
    "wind_direction_humidity_interaction", "pressure_humidity_interaction",
    "pm2_5_temp_interaction", "pm2_5_humidity_interaction", "pm2_5_pressure_interaction",
    "pm10_temperature_interaction", "pm10_pressure_interaction",
    "co_pressure_interaction", "o3_temp_interaction", "so2_humidity_interaction",
]

# fixed values: what the models are given, in training order -----------------------------
TREE_FEATURES = [
    "pm2_5_log_scaled", "pm10_scaled", "carbon_monoxide_scaled", "ozone_scaled", "sulphur_dioxide_scaled", "nh3_scaled",
    "temperature_scaled", "humidity_scaled", "pressure_scaled", "wind_speed_scaled",
    "wind_direction_sin", "wind_direction_cos",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
    "is_hot", "is_night", "is_morning_rush", "is_evening_rush", "is_high_pm2_5", "is_high_o3",
    "pm2_5_lag_1h_scaled", "pm2_5_lag_2h_scaled", "pm2_5_lag_3h_scaled", "pm2_5_lag_24h_scaled",
    "pm10_lag_1h_scaled", "pm10_lag_2h_scaled", "pm10_lag_3h_scaled", "pm10_lag_24h_scaled",
]
TREE_FEATURES_MULTI = ["co_lag_1h_scaled", "o3_lag_1h_scaled", "so2_lag_1h_scaled"]
TREE_FEATURES_LATER = [
    "pm2_5_rolling_min_3h_scaled", "pm2_5_rolling_mean_3h_scaled", "pm2_5_rolling_max_3h_scaled",
    "pm2_5_rolling_min_12h_scaled", "pm2_5_rolling_mean_12h_scaled", "pm2_5_rolling_max_12h_scaled",
    "pm2_5_rolling_mean_24h_scaled", "pm2_5_rolling_max_24h_scaled",
    "pm10_rolling_min_3h_scaled", "pm10_rolling_mean_3h_scaled", "pm10_rolling_mean_12h_scaled", "pm10_rolling_mean_24h_scaled",
    "pm2_5_change_rate_1h_scaled", "pm2_5_change_rate_6h_scaled", "pm2_5_change_rate_24h_scaled",
    "pm10_change_rate_1h_scaled", "pm10_change_rate_6h_scaled", "pm10_change_rate_24h_scaled",
    "pm2_5_temp_interaction_scaled", "pm2_5_humidity_interaction_scaled", "pm2_5_pressure_interaction_scaled",
    "pm10_temperature_interaction_scaled", "pm10_pressure_interaction_scaled",
    "temp_humidity_interaction_scaled", "temp_wind_interaction_scaled",
    "wind_direction_temp_interaction_scaled", "wind_direction_humidity_interaction_scaled",
    "pressure_humidity_interaction_scaled",
    "co_pressure_interaction_scaled", "o3_temp_interaction_scaled", "so2_humidity_interaction_scaled",
]
TREE_STEP_FEATURES = [
    "temperature_scaled", "humidity_scaled", "pressure_scaled", "wind_speed_scaled",
    "wind_direction_sin", "wind_direction_cos",
    "carbon_monoxide_scaled", "ozone_scaled", "sulphur_dioxide_scaled", "nh3_scaled",
]
ENCODER_FEATURES = [
    "pm2_5", "pm10",
    "pm2_5_rolling_mean_3h", "pm2_5_rolling_max_3h", "pm2_5_rolling_mean_12h", "pm2_5_rolling_max_12h",
    "pm2_5_rolling_mean_24h", "pm2_5_rolling_max_24h",
    "pm10_rolling_mean_3h", "pm10_rolling_mean_12h", "pm10_rolling_mean_24h",
    "pm2_5_change_rate_1h", "pm2_5_change_rate_6h", "pm2_5_change_rate_24h",
    "pm10_change_rate_1h", "pm10_change_rate_6h", "pm10_change_rate_24h",
    "pm2_5_temp_interaction", "pm2_5_humidity_interaction", "pm2_5_pressure_interaction",
    "pm10_temperature_interaction", "pm10_pressure_interaction",
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction_sin", "wind_direction_cos",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
    "carbon_monoxide", "ozone", "sulphur_dioxide", "nh3",
]
# read at the horizon by the tree trainers; those in the first two and the last list also as <name>_scaled
TREE_EXOG_WEATHER = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction"]
TREE_EXOG_POLLUTANTS = ["carbon_monoxide", "ozone", "sulphur_dioxide", "nh3"]
TREE_EXOG_FLAGS = ["is_hot", "is_night", "is_morning_rush", "is_evening_rush"]
TREE_EXOG_INTERACTIONS = [
    "temp_humidity_interaction", "temp_wind_interaction",
    "wind_direction_temp_interaction", "wind_direction_humidity_interaction",
    "pressure_humidity_interaction",
]
# months and hours (first, last) of the calendar flags; winter and night run over the end
SEASON_MONTHS = {"is_spring": (3, 5), "is_summer": (6, 8), "is_autumn": (9, 11), "is_winter": (12, 2)}
DAY_HOURS = {"is_night": (22, 6), "is_morning_rush": (7, 9), "is_evening_rush": (17, 19)}
# sine and cosine of the wind direction: beyond the first alone, or both beyond the second
WIND_HIGH_PM = (0.5, 0.3)
WIND_LOW_PM = -0.5
# contrast of means: limit of the difference, label below it, label above it
CONTRAST_LABELS = {
    "wind_speed": (1.0, "Calm air", "Windy"),
    "humidity": (10.0, "Dry", "Humid"),
    "temperature": (2.0, "Cool", "Hot"),
    "pressure": (2.0, "Low", "High"),
}
# mean of a target beyond which its scale is doubtful
TARGET_MEAN_LIMITS = {"pm2_5": 100.0, "pm10": 200.0}
# end of these fixed values -------------------------------------------------------------

# pollutant -> (c_lo, c_hi, i_lo, i_hi)
BREAKPOINTS = {
    "pm2_5": [
        (0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400),
        (350.5, 500.4, 401, 500),
    ],
    "pm10": [
        (0.0, 54.0, 0, 50), (55.0, 154.0, 51, 100), (155.0, 254.0, 101, 150),
        (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 504.0, 301, 400),
        (505.0, 604.0, 401, 500),
    ],
    "o3_8h": [
        (0.0, 54.0, 0, 50), (55.0, 70.0, 51, 100), (71.0, 85.0, 101, 150),
        (86.0, 105.0, 151, 200), (106.0, 200.0, 201, 300),
    ],
    "o3_1h": [
        (125.0, 164.0, 101, 150), (165.0, 204.0, 151, 200), (205.0, 404.0, 201, 300),
        (405.0, 504.0, 301, 400), (505.0, 604.0, 401, 500),
    ],
    "co": [
        (0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150),
        (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 40.4, 301, 400),
        (40.5, 50.4, 401, 500),
    ],
    "so2": [
        (0.0, 35.0, 0, 50), (36.0, 75.0, 51, 100), (76.0, 185.0, 101, 150),
        (186.0, 304.0, 151, 200), (305.0, 604.0, 201, 300), (605.0, 804.0, 301, 400),
        (805.0, 1004.0, 401, 500),
    ],
    "no2": [
        (0.0, 53.0, 0, 50), (54.0, 100.0, 51, 100), (101.0, 360.0, 101, 150),
        (361.0, 649.0, 151, 200), (650.0, 1249.0, 201, 300), (1250.0, 1649.0, 301, 400),
        (1650.0, 2049.0, 401, 500),
    ],
}

# the analysis variant joins the two top bands of CO, NO2 and SO2 into one
MERGED_TOP_BAND = {
    "co": (30.5, 50.4, 301, 500),
    "no2": (1250.0, 2049.0, 301, 500),
    "so2": (605.0, 1004.0, 301, 500),
}
OZONE_PPB_PER_UG = 0.5
CO_PPM_PER_UG = 0.000873

# name, lowest AQI, highest AQI, colour
AQI_CATEGORIES = [
    ("Good", 0, 50, "#009966"),
    ("Moderate", 51, 100, "#ffde33"),
    ("Unhealthy for Sensitive Groups", 101, 150, "#ff9933"),
    ("Unhealthy", 151, 200, "#cc0033"),
    ("Very Unhealthy", 201, 300, "#660099"),
    ("Hazardous", 301, 500, "#7e0023"),
]

COMPASS = [
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW",
]

# flag -> (column, comparison, threshold)
THRESHOLDS = {
    "is_hot": ("temperature", ">", 35.0),
    "is_cold": ("temperature", "<", 10.0),
    "is_high_humidity": ("humidity", ">", 80.0),
    "is_low_humidity": ("humidity", "<", 30.0),
    "is_high_wind": ("wind_speed", ">", 20.0),
    "is_calm": ("wind_speed", "<", 5.0),
    "is_low_pressure": ("pressure", "<", 1010.0),
    "is_high_pressure": ("pressure", ">", 1020.0),
    "is_high_pm2_5": ("pm2_5", ">", 35.0),
    "is_low_pm2_5": ("pm2_5", "<", 12.0),
    "is_high_pm10": ("pm10", ">", 50.0),
    "is_low_pm10": ("pm10", "<", 20.0),
    "is_high_no2": ("nitrogen_dioxide", ">", 200.0),
    "is_high_o3": ("ozone", ">", 100.0),
    "is_high_co": ("carbon_monoxide", ">", 5000.0),
    "is_high_so2": ("sulphur_dioxide", ">", 500.0),
}

# output -> (column, exponent)
POWERS = {
    "temp_squared": ("temperature", 2),
    "temp_cubed": ("temperature", 3),
    "humidity_squared": ("humidity", 2),
    "wind_speed_squared": ("wind_speed", 2),
    "pm2_5_squared": ("pm2_5", 2),
    "pm10_squared": ("pm10", 2),
    "no2_squared": ("nitrogen_dioxide", 2),
    "o3_squared": ("ozone", 2),
    "co_squared": ("carbon_monoxide", 2),
    "so2_squared": ("sulphur_dioxide", 2),
}

# output -> column of the row-to-row relative change
ROW_CHANGES = {
    "temp_change_rate": "temperature",
    "pressure_change_rate": "pressure",
    "pm2_5_change_rate": "pm2_5",
    "pm10_change_rate": "pm10",
    "no2_change_rate": "nitrogen_dioxide",
    "o3_change_rate": "ozone",
    "co_change_rate": "carbon_monoxide",
    "so2_change_rate": "sulphur_dioxide",
}

BASE_INTERACTIONS = {
    "temp_humidity_interaction": ("temperature", "humidity"),
    "temp_wind_interaction": ("temperature", "wind_speed"),
    "pm2_5_temp_interaction": ("pm2_5", "temperature"),
    "pm2_5_humidity_interaction": ("pm2_5", "humidity"),
    "wind_pm2_5_interaction": ("wind_speed", "pm2_5"),
}
EXTRA_INTERACTIONS = {
    "wind_direction_temp_interaction": ("wind_direction_sin", "temperature"),
    "wind_direction_humidity_interaction": ("wind_direction_sin", "humidity"),
    "pressure_humidity_interaction": ("pressure", "humidity"),
    "co_pressure_interaction": ("carbon_monoxide", "pressure"),
    "o3_temp_interaction": ("ozone", "temperature"),
    "so2_humidity_interaction": ("sulphur_dioxide", "humidity"),
    "pm2_5_pressure_interaction": ("pm2_5", "pressure"),
    "pm10_temperature_interaction": ("pm10", "temperature"),
    "pm10_pressure_interaction": ("pm10", "pressure"),
}

# output -> (column, hours); read from the unfilled readings
EXTRA_LAGS = {
    "co_lag_1h": ("carbon_monoxide", 1),
    "o3_lag_1h": ("ozone", 1),
    "so2_lag_1h": ("sulphur_dioxide", 1),
    "temp_lag_1h": ("temperature", 1),
    "wind_speed_lag_1h": ("wind_speed", 1),
    "humidity_lag_1h": ("humidity", 1),
    "pressure_lag_1h": ("pressure", 1),
    "ozone_lag_3h": ("ozone", 3),
}
EXTRA_ROLLING_HOURS = [3, 12]
EXTRA_ROLLING_COLUMNS = {
    "temp": "temperature",
    "humidity": "humidity",
    "wind_speed": "wind_speed",
    "pressure": "pressure",
    "ozone": "ozone",
}

# column -> (lowest, highest) plausible reading
RANGE_RULES = {
    "temperature": (-50.0, 60.0),
    "humidity": (0.0, 100.0),
    "pressure": (800.0, 1200.0),
    "wind_speed": (0.0, 50.0),
    "wind_direction": (0.0, 360.0),
}

# scaler groups
SCALE_GROUPS = {
    "pm": ["pm2_5", "pm10"],
    "weather": ["temperature", "humidity", "pressure", "wind_speed"],
    "pollutant": ["carbon_monoxide", "ozone", "sulphur_dioxide", "nh3"],
}

REPORT_HORIZONS = [1, 6, 12, 24, 48, 72]

# (first hour, last hour, weight) of the horizon-weighted loss
LOSS_BANDS = [(1, 3, 5.0), (4, 6, 3.0), (7, 24, 3.0), (25, 72, 1.0)]

# ---------------------------------------------------------------------------
# Payload schemas
# ---------------------------------------------------------------------------

POLLUTION_PAYLOAD = T.StructType([
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("dt", T.LongType()),
        T.StructField("main", T.StructType([T.StructField("aqi", T.IntegerType())])),
        T.StructField("components", T.MapType(T.StringType(), T.DoubleType())),
    ]))),
])

WEATHER_ITEM = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
    ])),
    T.StructField("wind", T.StructType([
        T.StructField("speed", T.DoubleType()),
        T.StructField("deg", T.DoubleType()),
    ])),
])
WEATHER_PAYLOAD = T.StructType([T.StructField("list", T.ArrayType(WEATHER_ITEM))])

MONITOR_PAYLOAD = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("current", T.StructType([
            T.StructField("pollution", T.StructType([
                T.StructField("ts", T.StringType()),
                T.StructField("aqius", T.IntegerType()),
            ])),
        ])),
    ])),
])
