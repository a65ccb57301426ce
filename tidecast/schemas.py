"""Column contracts of the tables the operators exchange."""

PANEL = "entity_id string, series_id string, period date, value double"
SERIES_META = (
    "series_id string, name string, grp string, freq string, transform int, pub_lag_days int, "
    "is_target boolean, dataset_id string, value_col string, filters map<string,string>"
)
RELEASE_CALENDAR = "series_id string, ref_period date, release_date date"
NOWCASTS = (
    "run_date date, entity_id string, target_quarter string, metric string, model string, value double"
)
ACTUALS_VINTAGE = (
    "quarter string, metric string, first_release_date date, first_value double, "
    "latest_value double, last_update_date date, base_year int"
)

ENTITY = ["entity_id"]
SERIES = ["entity_id", "series_id"]
