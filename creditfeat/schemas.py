"""Schemas of the six source tables and the fixed names used across the package."""

from __future__ import annotations

KEY = "customer_ref"
LABEL = "default"




# Column names of the sources.
APPLICATION_METADATA = (
    "customer_ref bigint, default int, application_id string, application_hour int, "
    "application_day_of_week int, account_open_year int, account_status_code string, "
    "preferred_contact string, referral_code string, num_login_sessions int, "
    "num_customer_service_calls int, has_mobile_app int, paperless_billing int, "
    "random_noise_1 double"
)
DEMOGRAPHICS = (
    "cust_id bigint, age int, marital_status string, num_dependents int, education string, "
    "employment_type string, employment_length double, annual_income string"
)
CREDIT_HISTORY = (
    "customer_number bigint, credit_score double, num_credit_accounts double, "
    "total_credit_limit double, oldest_account_age_months double, num_delinquencies_2yrs double, "
    "num_public_records double, num_collections double, num_inquiries_6mo double, "
    "recent_inquiry_count double, oldest_credit_line_age double, account_status string"
)
FINANCIAL_RATIOS = (
    "cust_num bigint, monthly_income string, existing_monthly_debt string, "
    "monthly_payment string, revolving_balance string, credit_usage_amount string, "
    "available_credit string, total_monthly_debt_payment string, total_debt_amount string, "
    "monthly_free_cash_flow string, debt_to_income_ratio double, debt_service_ratio double, "
    "payment_to_income_ratio double, credit_utilization double"
)
LOAN_DETAILS = (
    "customer_id bigint, loan_amount string, loan_type string, loan_term int, "
    "interest_rate double, loan_purpose string, collateral_value double"
)
GEOGRAPHIC_DATA = (
    "id string, state string, previous_zip_code string, regional_unemployment_rate string, "
    "regional_median_income string, regional_median_rent string, housing_price_index string, "
    "cost_of_living_index string"
)

# Satellite tables and the name their key has.
SATELLITE_KEYS = {
    "demographics": "cust_id",
    "credit_history": "customer_number",
    "financial_ratios": "cust_num",
    "loan_details": "customer_id",
    "geographic_data": "id",
}
ID_COLUMNS = ["cust_id", "customer_number", "cust_num", "customer_id", "id"]
NOISE_COLUMNS = ["random_noise_1"]
MONEY_COLUMNS = [
    "monthly_income",
    "existing_monthly_debt",
    "monthly_payment",
    "revolving_balance",
    "credit_usage_amount",
    "available_credit",
    "total_monthly_debt_payment",
    "total_debt_amount",
    "monthly_free_cash_flow",
]
GEO_NUMBERS = [
    "regional_unemployment_rate",
    "regional_median_income",
    "regional_median_rent",
    "housing_price_index",
    "cost_of_living_index",
]
EMPLOYMENT_TYPES = ["Full-time", "Part-time", "Self-employed", "Other"]
LOAN_TYPES = ["Personal", "Mortgage", "Credit Card", "Auto", "Other"]
TARGET_ENCODED = ["state", "marital_status", "education", "employment_type"]
WOE_COLUMNS = ["debt_to_income_ratio", "credit_utilization", "credit_score", "age"]
NEIGHBOURS = [50, 100, 500]
POLYNOMIAL_COLUMNS = ["credit_stress_score", "debt_to_income_ratio", "credit_utilization"]
