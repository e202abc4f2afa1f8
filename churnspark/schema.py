"""Schemas, name maps, category domains and length limits.

Everything the engine must agree on with the source system lives here, so that every
reader, cleaner and model stage uses one definition.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "customer_id"

# ---------------------------------------------------------------------------
# Fixed values (must equal the source system's for identical results).
# Customer table columns in table order, with the SQL types of the DDL.
# ---------------------------------------------------------------------------
CUSTOMER_COLUMNS = [
    ("customer_id", "string", 50),
    ("country", "string", 50),
    ("state", "string", 50),
    ("city", "string", 100),
    ("zip_code", "string", 10),
    ("lat_long", "string", 100),
    ("latitude", "decimal(10,6)", None),
    ("longitude", "decimal(10,6)", None),
    ("gender", "string", 10),
    ("age", "int", None),
    ("under_30", "string", 5),
    ("senior_citizen", "string", 5),
    ("partner", "string", 5),
    ("dependents", "string", 5),
    ("number_of_dependents", "int", None),
    ("tenure_in_months", "int", None),
    ("phone_service", "string", 5),
    ("multiple_lines", "string", 20),
    ("internet_service", "string", 20),
    ("internet_type", "string", 20),
    ("online_security", "string", 20),
    ("online_backup", "string", 20),
    ("device_protection", "string", 20),
    ("tech_support", "string", 20),
    ("streaming_tv", "string", 20),
    ("streaming_movies", "string", 20),
    ("contract", "string", 20),
    ("paperless_billing", "string", 5),
    ("payment_method", "string", 30),
    ("monthly_charge", "decimal(10,2)", None),
    ("total_charges", "decimal(10,2)", None),
    ("satisfaction_score", "int", None),
    ("customer_status", "string", 20),
    ("churn_label", "string", 5),
    ("churn_value", "int", None),
    ("churn_score", "int", None),
    ("cltv", "int", None),
    ("churn_category", "string", 50),
    ("churn_reason", "string", None),
]

# Inference log columns (append-only table).
LOG_COLUMNS = [
    ("inference_id", "bigint"),
    ("customer_id", "string"),
    ("churn_probability", "decimal(5,4)"),
    ("predicted_churn", "boolean"),
    ("model_version", "string"),
    ("created_at", "timestamp"),
]
DEFAULT_MODEL_VERSION = "v1.0"

# Topic source headers -> table columns, in source order.
LOCATION_MAP = {
    "Customer ID": "customer_id",
    "Country": "country",
    "State": "state",
    "City": "city",
    "Zip Code": "zip_code",
    "Lat Long": "lat_long",
    "Latitude": "latitude",
    "Longitude": "longitude",
}
DEMOGRAPHICS_MAP = {
    "Customer ID": "customer_id",
    "Gender": "gender",
    "Age": "age",
    "Under 30": "under_30",
    "Senior Citizen": "senior_citizen",
    "Married": "partner",
    "Dependents": "dependents",
    "Number of Dependents": "number_of_dependents",
}
SERVICES_MAP = {
    "Customer ID": "customer_id",
    "Tenure in Months": "tenure_in_months",
    "Phone Service": "phone_service",
    "Multiple Lines": "multiple_lines",
    "Internet Service": "internet_service",
    "Internet Type": "internet_type",
    "Online Security": "online_security",
    "Online Backup": "online_backup",
    "Device Protection Plan": "device_protection",
    "Premium Tech Support": "tech_support",
    "Streaming TV": "streaming_tv",
    "Streaming Movies": "streaming_movies",
    "Contract": "contract",
    "Paperless Billing": "paperless_billing",
    "Payment Method": "payment_method",
    "Monthly Charge": "monthly_charge",
    "Total Charges": "total_charges",
}
STATUS_MAP = {
    "Customer ID": "customer_id",
    "Satisfaction Score": "satisfaction_score",
    "Customer Status": "customer_status",
    "Churn Label": "churn_label",
    "Churn Value": "churn_value",
    "Churn Score": "churn_score",
    "CLTV": "cltv",
    "Churn Category": "churn_category",
    "Churn Reason": "churn_reason",
}

# Model features (model name space, Title Case).
NUMERIC_FEATURES = ["Tenure Months", "Monthly Charges", "Total Charges"]
CATEGORICAL_FEATURES = [
    "Gender",
    "Senior Citizen",
    "Partner",
    "Dependents",
    "Phone Service",
    "Multiple Lines",
    "Internet Service",
    "Online Security",
    "Online Backup",
    "Device Protection",
    "Tech Support",
    "Streaming TV",
    "Streaming Movies",
    "Contract",
    "Paperless Billing",
    "Payment Method",
]
TARGET = "Churn Value"

# Accepted aliases -> model feature name, in lookup order (first present wins).
FEATURE_ALIASES = {
    "tenure_in_months": "Tenure Months",
    "tenure_months": "Tenure Months",
    "monthly_charge": "Monthly Charges",
    "monthly_charges": "Monthly Charges",
    "total_charges": "Total Charges",
    "gender": "Gender",
    "senior_citizen": "Senior Citizen",
    "partner": "Partner",
    "dependents": "Dependents",
    "phone_service": "Phone Service",
    "multiple_lines": "Multiple Lines",
    "internet_service": "Internet Service",
    "online_security": "Online Security",
    "online_backup": "Online Backup",
    "device_protection": "Device Protection",
    "tech_support": "Tech Support",
    "streaming_tv": "Streaming TV",
    "streaming_movies": "Streaming Movies",
    "contract": "Contract",
    "paperless_billing": "Paperless Billing",
    "payment_method": "Payment Method",
    "churn_value": "Churn Value",
}

# Category domains of the what-if form and numeric ranges of its inputs.
FEATURE_OPTIONS = {
    "Gender": ["Male", "Female"],
    "Senior Citizen": ["Yes", "No"],
    "Partner": ["Yes", "No"],
    "Dependents": ["Yes", "No"],
    "Phone Service": ["Yes", "No"],
    "Internet Service": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "Paperless Billing": ["Yes", "No"],
    "Payment Method": [
        "Electronic check",
        "Mailed check",
        "Bank transfer (automatic)",
        "Credit card (automatic)",
    ],
}
# Services the what-if form does not ask for; they are sent as "No".
WHATIF_DEFAULTS = {
    "Multiple Lines": "No",
    "Online Security": "No",
    "Online Backup": "No",
    "Device Protection": "No",
    "Tech Support": "No",
    "Streaming TV": "No",
    "Streaming Movies": "No",
}

# Risk bands on the rounded probability.
RISK_HIGH = 0.7
RISK_MEDIUM = 0.4

# Forest parameters.
FOREST_PARAMS = {"num_trees": 200, "max_depth": 12, "min_leaf": 3, "seed": 42}
TEST_FRACTION = 0.2
SPLIT_SEED = 42
TOP_IMPORTANCES = 15
# ---------------------------------------------------------------------------

ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
ALL_CUSTOMER_FIELDS = [c for c, _, _ in CUSTOMER_COLUMNS if c != KEY]
STRING_LIMITS = {c: n for c, t, n in CUSTOMER_COLUMNS if t == "string" and n}


def customer_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t, _ in CUSTOMER_COLUMNS))


def customer_types() -> dict[str, str]:
    return {c: t for c, t, _ in CUSTOMER_COLUMNS}


def upload_csv_columns() -> list[str]:
    """The bulk-upload CSV carries every table column except tenure."""
    return [c for c, _, _ in CUSTOMER_COLUMNS if c != "tenure_in_months"]
