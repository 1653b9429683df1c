"""Fixed values that results depend on: word lists, aliases, column names, limits."""

from __future__ import annotations

# --- Fixed values: product roles and the column names accepted for each, in order of preference.
PRODUCT_ROLES = ("product_name", "description", "brand", "price", "category")
ROLE_ALIASES = {
    "product_name": ("product_name", "name", "title", "product_title"),
    "description": ("description", "product_description", "about_product", "name", "title"),
    "brand": ("brand", "manufacturer", "seller_name"),
    "price": ("price", "discount_price", "actual_price", "sale_price"),
    "category": ("category", "main_category", "sub_category", "label"),
}

# --- Fixed values: columns searched for text and labels.
TEXT_COLUMN_CANDIDATES = (
    "product_name",
    "description",
    "name",
    "title",
    "product_title",
    "product_description",
    "about_product",
)
CATEGORY_CANDIDATES = ("category", "main_category", "label")
SUB_CATEGORY_CANDIDATES = ("sub_category", "subcategory", "secondary_category")
LABEL_SEPARATOR = "|||"

# --- Fixed values: category texts that mean "no category".
PLACEHOLDER_CATEGORIES = (
    "",
    "na",
    "n/a",
    "none",
    "null",
    "unknown",
    "uncategorized",
    "not available",
    "not_applicable",
)
MAX_CATEGORY_LENGTH = 120
MAX_SAMPLE_ROWS = 20

# --- Fixed values: CSV cells read as missing.
CSV_NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- Fixed values: text cleaning.
STOP_WORDS = (
    "a",
    "an",
    "and",
    "are",
    "as",
    "at",
    "be",
    "by",
    "for",
    "from",
    "has",
    "have",
    "in",
    "into",
    "is",
    "it",
    "its",
    "of",
    "on",
    "or",
    "that",
    "the",
    "this",
    "to",
    "was",
    "were",
    "with",
    "without",
    "your",
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- Fixed values: text feature defaults.
MAX_FEATURES = 50_000
NGRAM_RANGE = (1, 2)
MIN_DF = 2
MAX_DF = 0.95

# --- Fixed values: meter series.
SERIES_TIME = "date"
SERIES_TARGET = "Usage_kWh"
SERIES_NUMERIC = (
    "Usage_kWh",
    "Lagging_Current_Reactive.Power_kVarh",
    "Leading_Current_Reactive_Power_kVarh",
    "CO2(tCO2)",
    "Lagging_Current_Power_Factor",
    "Leading_Current_Power_Factor",
    "NSM",
)
SERIES_CATEGORICAL = ("WeekStatus", "Day_of_week", "Load_Type")
SERIES_STEP_SECONDS = 900
LAGS = (1, 4, 96, 672)
ROLLING_MEANS = (4, 96)
ROLLING_STDS = (96,)
MODEL_NUMERIC = SERIES_NUMERIC[1:] + (
    "year",
    "month",
    "day",
    "day_of_year",
    "hour",
    "hour_sin",
    "hour_cos",
    "usage_lag_1",
    "usage_lag_4",
    "usage_lag_96",
    "usage_lag_672",
    "usage_rolling_mean_4",
    "usage_rolling_mean_96",
    "usage_rolling_std_96",
)
MODEL_CATEGORICAL = SERIES_CATEGORICAL

# --- Fixed values: classifiers in report order, and the regressor roster.
CLASSIFIER_ROSTER = ("Logistic Regression", "Naive Bayes", "Random Forest", "XGBoost")
REGRESSOR_ROSTER = ("linear_regression", "random_forest", "gradient_boosting")
OPTIONAL_REGRESSORS = ("xgboost", "lightgbm")

# --- Fixed values: drift.
PSI_BUCKETS = 10
PSI_THRESHOLD = 0.2
PSI_FLOOR = 1e-6
