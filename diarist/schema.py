"""Column names, level lists and the raw schema of a craving diary."""

KEY = "account_id"
TIME = "adjusted_craving_record_created"
OUTCOME = "craving_did_smoke"
ORDINAL = "entry_ordinal"

# The diary's column names and category levels.
FLAGS = [
    "craving_env_alone",
    "craving_env_colleagues",
    "craving_env_family",
    "craving_env_friends",
    "craving_env_partner",
    "craving_env_strangers",
    "craving_occupation_at_bar_or_event",
    "craving_occupation_chatting",
    "craving_occupation_coffee_or_tea",
    "craving_occupation_drinking",
    "craving_occupation_driving",
    "craving_occupation_going_to_bed",
    "craving_occupation_just_eaten",
    "craving_occupation_just_had_sex",
    "craving_occupation_reading",
    "craving_occupation_relaxing",
    "craving_occupation_taking_a_break",
    "craving_occupation_thinking",
    "craving_occupation_waking_up",
    "craving_occupation_working",
    "craving_occupation_other",
    "craving_feeling_annoyed",
    "craving_feeling_anxious",
    "craving_feeling_bored",
    "craving_feeling_down",
    "craving_feeling_happy",
    "craving_feeling_hungry",
    "craving_feeling_lonely",
    "craving_feeling_stressed",
    "craving_feeling_other",
]
RAW_COLUMNS = [
    "account_id", "quit_date", "timezone_offset", "cigs_per_day", "time_to_first_cig",
    "craving_record_created", "craving_date", "craving_severity", "craving_did_smoke",
    "did_someone_smoke",
] + FLAGS
CLEAN_COLUMNS = [
    "account_id", "adjusted_quit_date", "cigs_per_day", "adjusted_craving_record_created",
    "craving_severity", "craving_did_smoke", "prior_event_lapse",
] + FLAGS + [
    "time_to_first_cig", "wkday_craving", "time_of_day", "event_nr", "days_since_qd",
    "mins_since_prev_rep",
]
LEVELS = {
    "craving_did_smoke": ["false", "true"],
    "prior_event_lapse": ["no", "yes"],
    **{flag: ["false", "true"] for flag in FLAGS},
    "time_to_first_cig": ["<= 5", "6-30", "31-60", "> 60"],
    "wkday_craving": ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"],
    "time_of_day": ["morning", "midday", "evening", "night"],
}
MODELS = ["rf", "elnet", "svm", "xgb"]
METRICS = ["sens", "spec", "accuracy", "roc_auc"]

RAW_TIMES = ["quit_date", "craving_record_created", "craving_date"]

RAW_INTS = ["timezone_offset", "cigs_per_day", "craving_severity"]
