"""Data rules of the admission tables and seeds, for ``quality.run_checks``.

Stated as fixed values, grouped by kind.
"""

from __future__ import annotations

from seatflow.operators.quality import Rule

OPEN = "school_status != 'merged'"

KEYS = {
    "dim_school": ("school_key", "school_name_clean"),
    "dim_school_generalinfo": ("school_key", "url_address", "email_address"),
    "fact_balloting": ("balloting_key",),
    "mart_school_analysis": ("analysis_key",),
    "phases": ("phase_raw",),
    "balloting_codes": ("codes",),
    "school_lifecycle": ("school_name_clean",),
    "school_name_mapping": ("listed_name", "official_name"),
    "school_statuses": ("school_status",),
    "app_config": ("config_key",),
}

REQUIRED = {
    "dim_school": ("school_status", "is_active"),
    "dim_school_generalinfo": ("telephone_no", "principal_name", "first_vp_name"),
    "fact_balloting": ("school_key", "phase_normalised"),
    "mart_school_analysis": (
        "school_key", "phase_normalised", "registration_year", "is_current_year",
    ),
    "mart_vacancy_interim": ("school_name", "phase", "registration_year", "pct_filled"),
    "phases": ("phase_normalised", "valid_from_year", "is_competitive"),
    "school_lifecycle": ("school_status",),
    "app_config": ("config_value",),
}

REQUIRED_WHILE_OPEN = (
    "address postal_code dgp_code zone_code type_code nature_code session_code mainlevel_code "
    "sap_ind autonomous_ind gifted_ind ip_ind mothertongue1_code"
).split()

PARENTS = {
    ("dim_school", "school_status"): ("school_statuses", "school_status"),
    ("dim_school_generalinfo", "school_key"): ("dim_school", "school_key"),
    ("fact_balloting", "school_key"): ("dim_school", "school_key"),
    ("fact_balloting", "phase_normalised"): ("phases", "phase_normalised"),
    ("fact_balloting", "ballot_scenario_code"): ("balloting_codes", "codes"),
    ("mart_school_analysis", "school_key"): ("dim_school", "school_key"),
}

ACCEPTED = {
    ("mart_school_analysis", "phase_normalised"): ("2B", "2C", "2C(S)", "3"),
    ("mart_school_analysis", "ballot_risk_level"): ("HIGH", "MEDIUM", "LOW"),
    ("school_lifecycle", "school_status"): ("relocated_gap", "merged"),
}


def table_rules() -> list[Rule]:
    """All rules; a key is unique and known."""
    rules = [
        Rule(table, kind, column)
        for table, columns in KEYS.items()
        for column in columns
        for kind in ("unique", "not_null")
    ]
    rules += [Rule(t, "not_null", c) for t, columns in REQUIRED.items() for c in columns]
    rules += [Rule("dim_school", "not_null", c, where=OPEN) for c in REQUIRED_WHILE_OPEN]
    rules.append(Rule("fact_balloting", "not_null", "taken", where="applied is not null"))
    rules += [Rule(t, "relationship", c, arg=parent) for (t, c), parent in PARENTS.items()]
    rules += [Rule(t, "accepted", c, arg=values) for (t, c), values in ACCEPTED.items()]
    return rules


def rules_for(tables) -> list[Rule]:
    """The rules whose table and parent table are both at hand."""
    return [
        r
        for r in table_rules()
        if r.table in tables and (r.kind != "relationship" or r.arg[0] in tables)
    ]
