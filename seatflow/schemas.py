"""Declared schemas of the input and result tables."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def struct(text: str) -> T.StructType:
    """Schema from ``name type [not null], ...``; needs no running session."""
    fields = []
    for part in text.split(","):
        name, kind, *rest = part.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


RAW_BALLOTS = struct(
    "school_name string, total_vacancy bigint, phase string, vacancy bigint, applied bigint,"
    "taken bigint, ballot_scenario_code string, ballot_description string,"
    "ballot_applicants bigint, ballot_vacancies bigint, ballot_chance_pct double,"
    "registration_year bigint, scraped_at timestamp"
)

SCHOOL_TEXT_COLUMNS = (
    "school_name url_address address telephone_no telephone_no_2 fax_no fax_no_2 email_address "
    "mrt_desc bus_desc principal_name first_vp_name second_vp_name third_vp_name fourth_vp_name "
    "fifth_vp_name sixth_vp_name dgp_code zone_code type_code nature_code session_code "
    "mainlevel_code mothertongue1_code mothertongue2_code mothertongue3_code"
).split()

SCHOOL_FLAG_COLUMNS = ["sap_ind", "autonomous_ind", "gifted_ind", "ip_ind"]

RAW_SCHOOLS = struct(
    ", ".join(f"{c} string" for c in SCHOOL_TEXT_COLUMNS)
    + ", postal_code int, "
    + ", ".join(f"{c} boolean" for c in SCHOOL_FLAG_COLUMNS)
)

# Columns that change often and live in the general-info dimension.
SCHOOL_CONTACT_COLUMNS = (
    "url_address email_address telephone_no telephone_no_2 fax_no fax_no_2 mrt_desc bus_desc "
    "principal_name first_vp_name second_vp_name third_vp_name fourth_vp_name fifth_vp_name "
    "sixth_vp_name"
).split()

VACANCY_EVENTS = struct(
    "event_id string not null, phase string not null, registration_year int not null,"
    "school_name string not null, snapshot_timestamp timestamp not null,"
    "snapshot_type string not null, vacancy_at_open int not null,"
    "vacancy_remaining int not null, applied_count int not null, pct_filled double not null,"
    "simulation_day int not null"
)

SEED_PHASES = struct(
    "phase_raw string, phase_normalised string, phase_raw_label string,"
    "phase_normalised_label string, valid_from_year int, valid_to_year int,"
    "is_competitive boolean, balloting_required string, qualified_groups string,"
    "distance string, eligibility string"
)
SEED_BALLOTING_CODES = struct(
    "priority int, codes string, description string, additional_notes string,"
    "has_balloting boolean"
)
SEED_LIFECYCLE = struct(
    "school_name_clean string, school_status string, inactive_from_year int,"
    "inactive_to_year int, merged_into string"
)
SEED_NAME_MAPPING = struct("listed_name string, official_name string")
SEED_STATUSES = struct("school_status string, description string")
SEED_FLAGS = struct("config_key string, config_value boolean")

PREDICTIONS = struct(
    "school_name string not null, phase string not null, registration_year int not null,"
    "predicted_subscription_rate double not null, predicted_ballot_chance_pct double not null,"
    "model_version string not null, trained_at timestamp not null"
)

KNOWLEDGE_CHUNKS = struct(
    "doc_id string, domain string, topic string, source_file string, source_url string,"
    "policy_year int, canonical_source string, content string, embedding array<double>"
)
