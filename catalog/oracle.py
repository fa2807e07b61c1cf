"""SQL twins of the relational queries, for DuckDB over the same tables."""

import re

from diarist.functions.labels import GROUP_RULES, LABEL_RULES, METRIC_LABELS, MODEL_LABELS
from diarist.operators.features import NOMINAL, NUMERIC, dummy_name
from diarist.schema import CLEAN_COLUMNS, FLAGS, LEVELS, METRICS, MODELS, RAW_COLUMNS, TIME

ID = "entry_ordinal, account_id"
T = "adjusted_craving_record_created"
QUIT_FROM, QUIT_BEFORE, ENTRY_FROM = (
    f"TIMESTAMP '{x} 00:00:00'" for x in ("2023-10-01", "2024-01-16", "2024-01-01")
)


def cols(names):
    return ", ".join(names)


def quotient(part, whole):
    return f"({part})::DOUBLE / nullif({whole}, 0)"


def rnd(body, columns, digits=6):
    """``body`` with some columns rounded, as the last step."""
    return f"SELECT * REPLACE ({cols(f'round_even({c}, {digits}) AS {c}' for c in columns)}) FROM ({body})"


def share(part, whole, digits=6):
    """Half-even quotient; scaled first so that exact halves stay exact."""
    return f"round_even(({part}) * 1e{digits} / nullif({whole}, 0), 0) / 1e{digits}"


def _flag_sql(i, name):
    if name == "craving_feeling_stressed":
        return f"CASE WHEN value > 60 THEN 'true' ELSE 'false' END AS {name}"
    return (
        f"CASE WHEN (event_id * {3 + 2 * i} + k * {i + 1}) % 7 < 2 THEN 'true' ELSE 'false' END AS {name}"
    )


def case(column, mapping, other="NULL"):
    whens = " ".join(f"WHEN {column} = '{a}' THEN {b}" for a, b in mapping.items())
    return f"CASE {whens} ELSE {other} END"


CTES = {}
CTES["ev"] = """
 SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"""
CTES["raw"] = f"""
 SELECT event_id + nr * 1000000000000 AS entry_ordinal, concat('u', CAST(user_id AS VARCHAR)) AS account_id,
  CASE WHEN user_id % 11 = 0 THEN TIMESTAMP '2023-10-20 00:00:00'
       ELSE TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(user_id % 20 - 3 AS INT)) END AS quit_date,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST((user_id % 4 - 2) * 3600 AS INT) END AS timezone_offset,
  CAST(1 + (user_id * 7) % 110 AS INT) AS cigs_per_day,
  CASE CAST(user_id % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN '6-30' WHEN 2 THEN '31-60' WHEN 3 THEN '> 60'
       ELSE '<= 5' END AS time_to_first_cig,
  ts AS craving_record_created,
  CASE WHEN k = 7 THEN NULL ELSE ts - to_minutes(CAST(k * 20 - 30 AS INT)) END AS craving_date,
  CAST(1 + (k + nr) % 10 AS INT) AS craving_severity,
  CASE WHEN k = 99 THEN '' WHEN nr = 1 THEN CASE WHEN value > 70 THEN 'true' ELSE 'false' END
       WHEN user_id % 13 = 0 THEN 'false' WHEN user_id % 29 = 5 THEN 'true'
       WHEN event_type = 'error' AND (value > 40 OR k % 10 >= 5) THEN 'true'
       WHEN value > 150 THEN 'true' ELSE 'false' END AS craving_did_smoke,
  CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END AS did_someone_smoke,
  {cols(_flag_sql(i, n) for i, n in enumerate(FLAGS))}
 FROM (SELECT *, 0 AS nr FROM ev UNION ALL SELECT *, 1 FROM ev WHERE event_id % 50 = 0)"""
CTES["adj"] = """
 SELECT *, quit_date + to_seconds(coalesce(timezone_offset, 0)) AS adjusted_quit_date,
  craving_record_created + to_seconds(coalesce(timezone_offset, 0)) AS adjusted_craving_record_created,
  craving_date + to_seconds(coalesce(timezone_offset, 0)) AS adjusted_craving_date
 FROM raw"""
CTES["flagged"] = f"""
 SELECT *,
  coalesce(cigs_per_day < 101 AND time_to_first_cig <> '' AND craving_did_smoke <> ''
   AND craving_record_created IS NOT NULL, false) AS ok_eligible,
  coalesce(adjusted_quit_date >= {QUIT_FROM} AND adjusted_quit_date < {QUIT_BEFORE}
   AND {T} >= {ENTRY_FROM}, false) AS ok_study,
  CASE WHEN (epoch_us({T}) - epoch_us(adjusted_quit_date)) / 6.048e11 > 12 THEN 'exclude'
       WHEN (epoch_us({T}) - epoch_us(adjusted_quit_date)) / 6.048e11 < 0 THEN 'exclude'
       ELSE 'include' END AS relative_flag,
  CASE WHEN round_even((epoch_us({T}) - epoch_us(adjusted_craving_date)) / 3.6e9, 2) > 24 THEN 'exclude'
       WHEN round_even((epoch_us({T}) - epoch_us(adjusted_craving_date)) / 3.6e9, 2) < 0 THEN 'exclude'
       ELSE 'include' END AS recall_flag
 FROM adj"""
CTES["entries"] = """
 SELECT * FROM flagged
 WHERE ok_eligible AND ok_study AND relative_flag = 'include' AND recall_flag = 'include'"""
CTES["uniq"] = f"""
 SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY account_id, {T} ORDER BY entry_ordinal) AS rn FROM entries) WHERE rn = 1"""
CTES["cal"] = f"""
 SELECT *, coalesce(strftime({T}, '%a'), 'NA') AS wkday_craving, CAST(hour({T}) AS INT) AS hour_craving,
  CASE WHEN hour({T}) >= 5 AND hour({T}) < 11 THEN 'morning' WHEN hour({T}) >= 11 AND hour({T}) < 17 THEN 'midday'
       WHEN hour({T}) >= 17 AND hour({T}) < 22 THEN 'evening' ELSE 'night' END AS time_of_day
 FROM adj"""
CTES["clean"] = f"""
 SELECT * EXCLUDE (pt, po, no),
  CASE WHEN {T} > pt AND po = 'true' THEN 'yes' ELSE 'no' END AS prior_event_lapse,
  round_even((epoch_us({T}) - epoch_us(pt)) / 6e7, 0) AS mins_since_prev_rep,
  CASE WHEN no = 'true' THEN 'yes' ELSE 'no' END AS next_event_lapse,
  round_even((epoch_us({T}) - epoch_us(adjusted_quit_date)) / 8.64e10, 0) AS days_since_qd,
  coalesce(strftime({T}, '%a'), 'NA') AS wkday_craving,
  CASE WHEN hour({T}) BETWEEN 5 AND 10 THEN 'morning' WHEN hour({T}) BETWEEN 11 AND 16 THEN 'midday'
       WHEN hour({T}) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS time_of_day
 FROM (SELECT *, lag({T}) OVER w AS pt, lag(craving_did_smoke) OVER w AS po, lead(craving_did_smoke) OVER w AS no,
   row_number() OVER w AS event_nr, count(*) OVER (PARTITION BY account_id) AS n_entries,
   count(*) FILTER (craving_did_smoke = 'true') OVER (PARTITION BY account_id) AS n_lapses
  FROM uniq WINDOW w AS (PARTITION BY account_id ORDER BY {T}))"""
CTES["c20"] = "SELECT * FROM clean WHERE n_entries >= 20"
CTES["pred"] = """
 SELECT entry_ordinal AS row_id, account_id, CAST(craving_did_smoke = 'true' AS INT) AS label, 'rf' AS model,
  craving_severity / 10.0::DOUBLE AS score FROM c20
 UNION ALL SELECT entry_ordinal, account_id, CAST(craving_did_smoke = 'true' AS INT), 'elnet',
  CASE WHEN craving_feeling_stressed = 'true' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END FROM c20
 UNION ALL SELECT entry_ordinal, account_id, CAST(craving_did_smoke = 'true' AS INT), 'svm',
  ('0x' || substr(md5(CAST(entry_ordinal AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE FROM c20
 UNION ALL SELECT entry_ordinal, account_id, CAST(craving_did_smoke = 'true' AS INT), 'xgb', 0.5::DOUBLE
  FROM c20 WHERE n_entries >= 25"""


def class_metrics(table, keys):
    by = cols(keys)
    return f"""
 SELECT {by}, {quotient("count(*) FILTER (label = 1 AND score >= 0.5)", "count(*) FILTER (label = 1)")} AS sens,
  {quotient("count(*) FILTER (label = 0 AND score < 0.5)", "count(*) FILTER (label = 0)")} AS spec,
  {quotient("count(*) FILTER ((label = 1) = (score >= 0.5))", "count(*)")} AS accuracy
 FROM {table} GROUP BY {by}"""


def pairwise_auc(table, keys):
    """AUC and DeLong interval by ranks with ties at half. The AUC is one division of exact sums,
    so that a value halfway between two digits stays there."""
    by = cols(keys)
    return f"""
 SELECT {by}, n_pos, n_neg, auc,
  CASE WHEN v IS NOT NULL THEN greatest(least(auc - 1.959964 * sqrt(greatest(v, 0)), 1), 0) END AS ci_lower,
  CASE WHEN v IS NOT NULL THEN greatest(least(auc + 1.959964 * sqrt(greatest(v, 0)), 1), 0) END AS ci_upper
 FROM (SELECT {by}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
   sum(wins) FILTER (label = 1) / nullif(max(m) * max(n), 0) AS auc,
   var_samp(v10) FILTER (label = 1 AND n > 0) / nullif(count(*) FILTER (label = 1), 0)
   + var_samp(v01) FILTER (label = 0 AND m > 0) / nullif(count(*) FILTER (label = 0), 0) AS v
  FROM (SELECT {by}, label, m, n, below_neg - same_neg / 2.0::DOUBLE AS wins, (below_neg - same_neg / 2.0::DOUBLE) / nullif(n, 0) AS v10,
    (m - below_pos + same_pos / 2.0::DOUBLE) / nullif(m, 0) AS v01
   FROM (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY {by}) AS m,
     count(*) FILTER (label = 0) OVER (PARTITION BY {by}) AS n,
     count(*) FILTER (label = 0) OVER (PARTITION BY {by} ORDER BY score) AS below_neg,
     count(*) FILTER (label = 1) OVER (PARTITION BY {by} ORDER BY score) AS below_pos,
     count(*) FILTER (label = 0) OVER (PARTITION BY {by}, score) AS same_neg,
     count(*) FILTER (label = 1) OVER (PARTITION BY {by}, score) AS same_pos FROM {table}))
  GROUP BY {by})"""


def metric_rows(table, keys):
    by = cols(keys)
    return f"""
 SELECT {by}, unnest(['sens', 'spec', 'accuracy', 'roc_auc']) AS metric, unnest([sens, spec, accuracy, auc]) AS estimate
 FROM ({class_metrics(table, keys)}) JOIN ({pairwise_auc(table, keys)}) USING ({by})"""


def curve(table, keys):
    by = cols(keys)
    return f"""
 SELECT {by}, threshold, specificity, sensitivity FROM (
  SELECT DISTINCT {by}, score AS threshold, {quotient("n - at_neg", "n")} AS specificity, {quotient("at_pos", "m")} AS sensitivity
  FROM (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY {by}) AS m,
    count(*) FILTER (label = 0) OVER (PARTITION BY {by}) AS n,
    count(*) FILTER (label = 0) OVER (PARTITION BY {by} ORDER BY score DESC) AS at_neg,
    count(*) FILTER (label = 1) OVER (PARTITION BY {by} ORDER BY score DESC) AS at_pos FROM {table})
  UNION ALL SELECT DISTINCT {by}, '-inf'::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM {table}
  UNION ALL SELECT DISTINCT {by}, 'inf'::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM {table})"""


CTES["auc"] = pairwise_auc("pred", ["account_id", "model"])
CTES["met"] = metric_rows("pred", ["account_id", "model"])
CTES["wide"] = f"""
 SELECT account_id, model, {cols(f"max(estimate) FILTER (metric = '{m}') AS {m}" for m in METRICS)}
 FROM met GROUP BY account_id, model"""


def model_order(names):
    return f"list_position({list(names)}, model)"


RANKING = "roc_auc DESC NULLS LAST, accuracy DESC NULLS LAST, spec DESC NULLS LAST, sens DESC NULLS LAST"
CTES["best"] = f"""
 SELECT account_id, model, {cols(METRICS)} FROM (SELECT *, row_number() OVER
  (PARTITION BY account_id ORDER BY {RANKING}, {model_order(MODELS)}) AS rn FROM wide) WHERE rn = 1"""
CTES["bestlong"] = f"""
 SELECT account_id, model, unnest({METRICS}) AS metric, unnest([{cols(METRICS)}]) AS value FROM best"""
CTES["grp"] = "SELECT account_id, auc FROM auc WHERE model = 'rf' AND auc IS NOT NULL"


def indicators(columns):
    return {
        dummy_name(c, nr, level): f"CASE WHEN {c} = '{level}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        for c in columns for nr, level in enumerate(LEVELS[c]) if nr > 0
    }


_IMP = indicators(["prior_event_lapse"] + FLAGS + ["time_to_first_cig", "wkday_craving", "time_of_day"]) | {
    "craving_severity": "craving_severity / 10.0::DOUBLE", "cigs_per_day": "cigs_per_day / 200.0::DOUBLE",
    "days_since_qd": "days_since_qd / 100.0::DOUBLE",
    "mins_since_prev_rep": "coalesce(mins_since_prev_rep, 0) / 100000.0::DOUBLE",
}
CTES["imp"] = f"""
 SELECT account_id, variable, model, round_even(CASE model WHEN 'rf' THEN abs(r_on - r_off) WHEN 'elnet' THEN r_on
   WHEN 'svm' THEN r_off ELSE (r_on + r_off) / 2 END, 6) AS importance
 FROM (SELECT account_id, unnest({list(_IMP)}) AS variable,
   unnest([{cols(f"coalesce(avg({x}) FILTER (craving_did_smoke = 'true'), 0)" for x in _IMP.values())}]) AS r_on,
   unnest([{cols(f"coalesce(avg({x}) FILTER (craving_did_smoke = 'false'), 0)" for x in _IMP.values())}]) AS r_off
  FROM c20 GROUP BY account_id), (SELECT unnest({MODELS}) AS model)"""
CTES["top10"] = """
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id, model
  ORDER BY importance DESC NULLS LAST, variable) AS INT) AS rank FROM imp) WHERE rank <= 10"""
CTES["bestimp"] = """
 SELECT account_id, model, variable, importance
 FROM (SELECT account_id, model FROM best) LEFT JOIN top10 USING (account_id, model)"""


def ranked(source, keys, seed, row="entry_ordinal"):
    """Rows of ``source`` numbered in draw order within ``keys``."""
    part = f"PARTITION BY {cols(keys)}" if keys else ""
    return f"""(SELECT *, row_number() OVER ({part} ORDER BY md5(concat('{seed}:', CAST({row} AS VARCHAR))), {row})
  AS draw_rank, count(*) OVER ({part}) AS draw_n FROM {source})"""


CTES["split"] = f"""
 SELECT * EXCLUDE (draw_rank, draw_n), CASE WHEN draw_rank <= floor(0.8::DOUBLE * draw_n) THEN 'training'
  ELSE 'testing' END AS split FROM {ranked("c20", [], "555")}"""


def hybrid(fraction):
    return f"""
 SELECT * EXCLUDE (draw_rank, draw_n), CASE WHEN draw_rank <= round_even({fraction}::DOUBLE * draw_n, 0)
  THEN 'training' ELSE 'testing' END AS role FROM {ranked("c20", ["account_id"], "555:hybrid")}"""


CTES["hyb"] = hybrid(0.2)
CTES["mixed"] = "SELECT * FROM c20 WHERE n_lapses > 0 AND n_lapses < n_entries"
CTES["folded"] = f"""
 SELECT entry_ordinal AS row_id, CAST((draw_rank - 1) % 10 AS INT) AS fold FROM {ranked("c20", [], "555:fold")}"""
CTES["shifted"] = """
 SELECT model, param_id, fold, label, CASE WHEN param_id = 0 THEN score ELSE abs(score - 0.5) END AS score
 FROM pred JOIN folded USING (row_id), (SELECT unnest([0, 1])::INT AS param_id)"""
CTES["tun"] = metric_rows("shifted", ["model", "param_id", "fold"])
CTES["collected"] = """
 SELECT model, param_id, metric, avg(estimate) AS mean, count(estimate) AS n,
  stddev_samp(estimate) / sqrt(count(estimate)) AS std_err
 FROM tun GROUP BY model, param_id, metric"""
_DEPENDS = {name: set(re.findall(r"\b[a-z0-9]+\b", text)) & set(CTES) - {name} for name, text in CTES.items()}


def common_tables(body):
    """Definitions of the common tables ``body`` uses, in order."""
    need, todo = set(), set(re.findall(r"\b[a-z0-9]+\b", body)) & set(CTES)
    while todo:
        name = todo.pop()
        need.add(name)
        todo |= _DEPENDS[name] - need
    return ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need)


def with_ctes(body):
    """``body`` after its common tables; it may go on with tables of its own."""
    head = "WITH " + common_tables(body)
    return f"{head},\n{body[len('WITH '):]}" if body.startswith("WITH ") else f"{head}\n{body}"


SQL = {}
SQL["scan_diary"] = f"SELECT {cols(RAW_COLUMNS)} FROM raw"
SQL["write_if_absent"] = 'SELECT account_id, count(*) AS "count" FROM clean GROUP BY account_id'
SQL["read_clean"] = f"SELECT entry_ordinal, {cols(CLEAN_COLUMNS)} FROM clean"
SQL["read_clean_bucketed"] = f"""SELECT entry_ordinal, account_id, row_number() OVER (PARTITION BY account_id ORDER BY {TIME}) AS number,
 count(*) OVER (PARTITION BY account_id) AS entries, count(*) FILTER (craving_did_smoke = 'true') OVER (PARTITION BY account_id) AS lapses FROM clean"""
SQL["clean_diary"] = (
    f"SELECT entry_ordinal, {cols(CLEAN_COLUMNS)}, next_event_lapse, n_entries, n_lapses FROM clean"
)
SQL["roc_panels"] = f"""SELECT 'all' AS analysis, model, round_even(threshold, 6) AS threshold, specificity, sensitivity
 FROM ({curve("pred", ["model"])})
 UNION ALL SELECT 'stressed', model, round_even(threshold, 6), specificity, sensitivity
 FROM ({curve("(SELECT * FROM pred WHERE score >= 0.2)", ["model"])})"""
SQL["eligible_entries"] = f"SELECT entry_ordinal, {cols(RAW_COLUMNS)} FROM flagged WHERE ok_eligible"
SQL["project_by_list"] = f"SELECT {cols(RAW_COLUMNS)} FROM raw"
SQL["drop_columns"] = f"SELECT entry_ordinal, {cols(RAW_COLUMNS[:9])} FROM raw"
SQL["study_window"] = f"SELECT {ID}, adjusted_quit_date, {T} FROM flagged WHERE ok_eligible AND ok_study"
SQL["relative_window"] = f"SELECT {ID}, adjusted_quit_date, {T} FROM flagged WHERE relative_flag = 'include'"
SQL["recall_window"] = f"SELECT {ID}, adjusted_craving_date, {T} FROM flagged WHERE recall_flag = 'include'"
SQL["dedup_entries"] = f"SELECT {ID}, {T}, craving_did_smoke, craving_severity FROM uniq"
SQL["min_entries"] = f"SELECT {ID}, craving_did_smoke FROM c20"
SQL["mixed_outcome_accounts"] = f"SELECT {ID}, craving_did_smoke FROM mixed"
SQL["any_lapse_accounts"] = f"SELECT {ID}, craving_did_smoke FROM c20 WHERE n_lapses > 0"
SQL["class_count_cutoff"] = (
    f"SELECT {ID}, craving_did_smoke FROM c20 WHERE n_lapses > 5 AND n_entries - n_lapses > 5"
)
SQL["class_cutoff_accounts"] = """SELECT at_least, count(*) AS accounts, count(*) FILTER (n_lapses > 5) AS over_5_true,
  count(*) FILTER (n_entries - n_lapses > 5) AS over_5_false,
  count(*) FILTER (n_lapses > 5 AND n_entries - n_lapses > 5) AS over_5_both
 FROM (SELECT DISTINCT account_id, n_entries, n_lapses FROM clean), (SELECT unnest([1, 10, 20])::INT AS at_least)
 WHERE n_entries >= at_least GROUP BY at_least"""
SQL["impute_zero"] = f"SELECT {ID}, coalesce(mins_since_prev_rep, 0) AS mins_since_prev_rep FROM c20"
SQL["drop_null_keys"] = f"""SELECT {ID}, timezone_offset FROM adj
 WHERE timezone_offset IS NOT NULL AND adjusted_craving_date IS NOT NULL"""
SQL["rename_cols"] = "SELECT account_id, auc AS group_auc FROM grp"
SQL["keep_metrics"] = "SELECT account_id, model, metric, estimate FROM met WHERE metric IN ('roc_auc', 'accuracy')"
SQL["tag_column"] = "SELECT account_id, auc, 'Random Forest' AS model FROM grp"
SQL["complete_accounts"] = "SELECT account_id FROM met GROUP BY account_id HAVING count(DISTINCT model) = 4"
SQL["parse_times"] = f"""SELECT {ID}, TRY_CAST(CASE entry_ordinal % 10 WHEN 3 THEN 'not a time' WHEN 4 THEN ''
  ELSE CAST(craving_record_created AS VARCHAR) END AS TIMESTAMP) AS written FROM raw"""
SQL["apply_offset"] = f"SELECT {ID}, adjusted_quit_date, {T}, adjusted_craving_date FROM adj"
SQL["time_diff"] = f"""SELECT {ID}, {cols(
    f"(epoch_us({T}) - epoch_us(adjusted_quit_date)) / {k} AS {u}"
    for u, k in (("mins", "6e7"), ("hours", "3.6e9"), ("days", "8.64e10"), ("weeks", "6.048e11")))} FROM adj"""
SQL["calendar_fields"] = f"SELECT {ID}, wkday_craving, hour_craving, time_of_day FROM cal"
SQL["days_since_quit"] = f"SELECT {ID}, days_since_qd FROM clean"
SQL["category_levels"] = f"""SELECT {ID}, time_to_first_cig, CAST(CASE time_to_first_cig WHEN '<= 5' THEN 1
  WHEN '6-30' THEN 2 WHEN '31-60' THEN 3 WHEN '> 60' THEN 4 END AS INT) AS level_nr FROM raw"""
SQL["cast_columns"] = f"""SELECT {ID}, TRY_CAST(time_to_first_cig AS INT) AS number,
  CAST(cigs_per_day AS VARCHAR) AS text FROM raw"""


def label_sql(name, rules):
    for kind, *args in LABEL_RULES[rules]:
        if kind == "all":
            name = f"regexp_replace({name}, '{args[0]}', '{args[1]}', 'g')"
        elif kind == "first":
            name = f"regexp_replace({name}, '{args[0]}', '{args[1]}')"
        elif kind == "trim":
            name = f"trim({name})"
        else:
            name = (
                f"list_transform([{name}], lambda x: concat(repeat(' ', length(x) - length(ltrim(x))),"
                " upper(substr(ltrim(x), 1, 1)), lower(substr(ltrim(x), 2))))[1]"
            )
    return name


def group_sql(label):
    whens = " ".join(f"WHEN regexp_matches({label}, '{p}') THEN '{g}'" for p, g in GROUP_RULES)
    return f"CASE {whens} ELSE {label} END"


SQL["feature_labels"] = f"""SELECT variable, count(DISTINCT account_id) AS accounts,
 {cols(f"{label_sql('variable', r)} AS label_{r}" for r in LABEL_RULES)} FROM imp GROUP BY variable"""
SQL["feature_groups"] = f"""SELECT variable, regexp_replace(variable, '.*_', '') AS suffix,
 {group_sql("label")} AS feature_group, most
 FROM (SELECT variable, {label_sql("variable", "individual")} AS label, max(importance) AS most
  FROM imp GROUP BY variable)"""
SQL["model_names"] = f"""SELECT account_id, upper(model) AS model,
 {case("metric", {a: f"'{b}'" for a, b in METRIC_LABELS.items()})} AS metric, estimate FROM met"""
_COMPARED = """SELECT account_id, model, roc_auc AS model_auc, auc AS group_auc,
 roc_auc >= auc AS individual_preferred FROM best LEFT JOIN grp USING (account_id)"""
SQL["compare_to_group"] = _COMPARED
SQL["preference_share"] = f"""SELECT count(*) AS accounts,
 {share("100 * count(*) FILTER (individual_preferred)", "count(*)")} AS percent_preferred,
 {share("100 * count(*) FILTER (NOT individual_preferred)", "count(*)")} AS percent_not_preferred FROM ({_COMPARED})"""
SQL["best_model_importance"] = "SELECT account_id, model, variable, importance FROM bestimp"
SQL["restrict_to_accounts"] = f"""SELECT {ID}, {T} FROM entries
 WHERE account_id IN (SELECT account_id FROM clean WHERE n_entries >= 30)"""
SQL["remove_sampled_rows"] = f"SELECT {ID}, craving_did_smoke FROM hyb WHERE role = 'testing'"
SQL["combine_algorithms"] = f"""SELECT account_id, metric, {cols(
    f"max(estimate) FILTER (model = '{m}') AS {m}" for m in MODELS)} FROM met GROUP BY account_id, metric"""
SQL["leave_one_account_out"] = """SELECT h.account_id, count(*) FILTER (h.account_id = r.account_id) AS testing,
 count(*) FILTER (h.account_id <> r.account_id) AS training
 FROM (SELECT DISTINCT account_id FROM mixed) h, mixed r GROUP BY h.account_id"""
SQL["holdout_groups"] = f"""SELECT holdout, CAST(sum(n) AS BIGINT) AS testing, count(*) AS accounts
 FROM (SELECT n, CAST((draw_rank - 1) % 10 AS INT) AS holdout FROM {ranked(
    "(SELECT account_id, count(*) AS n FROM c20 GROUP BY account_id)", [], "555:holdout", "account_id")})
 GROUP BY holdout"""
SQL["entries_per_account"] = 'SELECT account_id, count(*) AS "count" FROM clean GROUP BY account_id'

_STAGE_ROWS = [
    ("raw", "SELECT account_id FROM raw"),
    ("eligible", "SELECT account_id FROM flagged WHERE ok_eligible"),
    ("study_window", "SELECT account_id FROM flagged WHERE ok_eligible AND ok_study"),
    ("relative_window",
     "SELECT account_id FROM flagged WHERE ok_eligible AND ok_study AND relative_flag = 'include'"),
    ("recall_window", "SELECT account_id FROM entries"),
    ("dedup", "SELECT account_id FROM uniq"),
]
SQL["attrition"] = f"""SELECT CAST(nr AS INT) AS stage_nr, stage, n AS entries, accounts,
 coalesce(lag(accounts) OVER (ORDER BY nr), accounts) - accounts AS accounts_lost FROM ({" UNION ALL ".join(
    f"SELECT {i} AS nr, '{s}' AS stage, count(*) AS n, count(DISTINCT account_id) AS accounts FROM ({q})"
    for i, (s, q) in enumerate(_STAGE_ROWS))})"""
SQL["coverage_thresholds"] = f"""SELECT at_least, accounts_before,
 {share("100 * accounts_before", "everyone")} AS percent_before, accounts_after,
 {share("100 * accounts_after", "everyone")} AS percent_after
 FROM (SELECT at_least, count(*) AS everyone, count(*) FILTER (b >= at_least) AS accounts_before,
   count(*) FILTER (a >= at_least) AS accounts_after
  FROM (SELECT DISTINCT account_id FROM raw)
  LEFT JOIN (SELECT account_id, count(*) AS b FROM entries GROUP BY account_id) USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS a FROM uniq GROUP BY account_id) USING (account_id),
  (SELECT unnest([1, 5, 10, 20, 30, 50])::INT AS at_least) GROUP BY at_least)"""
_FIRST = "(SELECT * FROM c20 WHERE event_nr = 1)"


def tabulate(source, column):
    return f"""SELECT {column}, n, {share("n", "total")} AS percent
 FROM (SELECT {column}, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY {column})"""


SQL["tabulate_one"] = tabulate(_FIRST, "time_to_first_cig")
SQL["tabulate_two"] = """SELECT account_id, count(*) FILTER (craving_did_smoke = 'false') AS "false",
 count(*) FILTER (craving_did_smoke = 'true') AS "true" FROM c20 GROUP BY account_id"""
for _name in ("relative", "recall"):
    SQL[f"{_name}_flags"] = f"""SELECT account_id, {_name}_flag AS flag, count(*) AS n FROM flagged
 GROUP BY GROUPING SETS ((account_id, {_name}_flag), ({_name}_flag))"""
SQL["mean_sd"] = f"""SELECT round_even(avg(cigs_per_day), 6) AS mean, round_even(stddev_samp(cigs_per_day), 6) AS sd
 FROM {_FIRST}"""
SQL["median_range"] = """SELECT round_even(median(n), 6) AS median, min(n) AS min, max(n) AS max
 FROM (SELECT count(*) AS n FROM clean GROUP BY account_id)"""
_SAMPLES = """(SELECT * FROM clean, (SELECT unnest([1, 10, 20])::INT AS at_least)
 WHERE event_nr = 1 AND n_entries >= at_least)"""
SQL["sample_characteristics"] = f"""SELECT at_least, count(*) AS accounts, CAST(sum(n_entries) AS BIGINT) AS entries,
 round_even(median(n_entries), 6) AS median_entries, min(n_entries) AS min_entries, max(n_entries) AS max_entries,
 round_even(avg(cigs_per_day), 6) AS mean_cigs, round_even(stddev_samp(cigs_per_day), 6) AS sd_cigs
 FROM {_SAMPLES} GROUP BY at_least"""
SQL["sample_levels"] = f"""SELECT at_least, time_to_first_cig, n,
 {share("n", "sum(n) OVER (PARTITION BY at_least)")} AS percent
 FROM (SELECT at_least, time_to_first_cig, count(*) AS n FROM {_SAMPLES} GROUP BY at_least, time_to_first_cig)"""
SQL["outcome_counts_wide"] = """SELECT account_id, nullif(count(*) FILTER (craving_did_smoke = 'false'), 0) AS n_false,
 nullif(count(*) FILTER (craving_did_smoke = 'true'), 0) AS n_true FROM c20 GROUP BY account_id"""
SQL["outcome_share"] = tabulate("c20", "craving_did_smoke").replace("AS percent", "AS prop")
_SHARES = f"""SELECT account_id, "false", "true", {share('"true"', '"false" + "true"', 2)} AS prop
 FROM ({SQL["tabulate_two"]})"""
SQL["lapse_share_per_account"] = _SHARES
SQL["lapse_share_summary"] = f"""SELECT count(*) AS accounts, {cols(
    f"{share(f'100 * count(*) FILTER (prop {t})', 'count(*)')} AS percent_{n}"
    for n, t in (("none", "= 0"), ("all", "= 1"), ("over_70", "> 0.7::DOUBLE"), ("over_60", "> 0.6::DOUBLE"),
                 ("over_50", "> 0.5")))} FROM ({_SHARES})"""
_DAYS = "SELECT account_id, max(days_since_qd) AS days FROM c20 GROUP BY account_id"
_GAPS = "SELECT account_id, median(coalesce(mins_since_prev_rep, 0)) AS mins FROM c20 GROUP BY account_id"
SQL["max_days_since_quit"] = _DAYS
SQL["median_gap"] = _GAPS
SQL["gap_range"] = """SELECT round_even(median(x), 6) AS median, min(x) AS min, max(x) AS max
 FROM (SELECT coalesce(mins_since_prev_rep, 0) AS x FROM c20)"""
_LAST = "(SELECT * FROM c20 WHERE event_nr = n_entries)"
SQL["last_entry"] = f"SELECT {ID}, {T}, craving_did_smoke FROM {_LAST}"
SQL["last_outcome"] = tabulate(_LAST, "craving_did_smoke")
SQL["relapse_transition"] = f"""SELECT lapses, followed_by_lapse, {share("100 * followed_by_lapse", "lapses")} AS percent
 FROM (SELECT count(*) AS lapses, count(*) FILTER (next_event_lapse = 'yes') AS followed_by_lapse
  FROM c20 WHERE craving_did_smoke = 'true')"""
SQL["endorsement_rates"] = f"""SELECT predictor, regexp_replace(predictor, '.*_', '') AS legend, craving_did_smoke,
 concat(upper(substr(craving_did_smoke, 1, 1)), substr(craving_did_smoke, 2), chr(10), '(N=', CAST(total AS VARCHAR), ')')
  AS outcome_label, level, n, {share("n", "total")} AS prop
 FROM (SELECT predictor, craving_did_smoke, level, count(*) AS n,
   sum(count(*)) OVER (PARTITION BY predictor, craving_did_smoke) AS total
  FROM (UNPIVOT (SELECT craving_did_smoke, {cols(NOMINAL)} FROM c20) ON {cols(NOMINAL)}
   INTO NAME predictor VALUE level) GROUP BY predictor, craving_did_smoke, level)"""


def histogram_sql(source, value, by=(), limits=None, bins=30):
    keys = "".join(f"{b}, " for b in by)
    inside = f"WHERE x BETWEEN {limits[0]} AND {limits[1]}" if limits else "WHERE x IS NOT NULL"
    ends = f"{limits[0]}::DOUBLE AS lo, {limits[1]}::DOUBLE AS hi" if limits else "min(x) AS lo, max(x) AS hi"
    return f"""WITH vals AS (SELECT * FROM (SELECT {keys} CAST({value} AS DOUBLE) AS x FROM {source}) {inside}),
 ends AS (SELECT {ends} FROM vals LIMIT 1),
 grid AS (SELECT CASE WHEN hi > lo THEN (hi - lo) / {bins - 1} ELSE 0.1::DOUBLE END AS w, lo FROM ends),
 edges AS (SELECT w, w / 2 + floor((lo - w / 2) / w) * w AS o FROM grid),
 hits AS (SELECT {keys} CAST(greatest(ceil((x - o) / w - 1e-8), 1) AS INT) AS bin_nr, count(*) AS c
  FROM vals, edges GROUP BY ALL),
 cells AS (SELECT * FROM (SELECT DISTINCT {keys} 1 AS one FROM vals), edges,
  (SELECT unnest(range(1, {bins + 1}))::INT AS bin_nr))
 SELECT {keys} bin_nr, round_even(o + (bin_nr - 1) * w, 6) AS x_min, round_even(o + bin_nr * w, 6) AS x_max,
  coalesce(c, 0) AS "count" FROM cells LEFT JOIN hits USING ({keys} bin_nr)"""


_HIST = {
    "histogram_lapse_share": (f"({_SHARES})", "prop"),
    "histogram_days": (f"({_DAYS})", "days"),
    "histogram_gap": (f"({_GAPS})", "mins"),
    "histogram_cigs_by_outcome": ("c20", "cigs_per_day", ["craving_did_smoke"]),
    "histogram_severity_by_outcome": ("c20", "craving_severity", ["craving_did_smoke"]),
    "histogram_days_by_outcome": ("c20", "days_since_qd", ["craving_did_smoke"]),
    "histogram_by_model": (
        "(SELECT * FROM bestlong WHERE metric IN ('roc_auc', 'accuracy'))", "value", ["metric", "model"], (0, 1.1)
    ),
}
SQL["box_stats"] = f"""SELECT model, round_even(q1, 6) AS q1, round_even(median, 6) AS median, round_even(q3, 6) AS q3,
 round_even(min(roc_auc) FILTER (roc_auc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
 round_even(max(roc_auc) FILTER (roc_auc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
 count(*) FILTER (roc_auc NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
 FROM wide JOIN (SELECT model, quantile_cont(roc_auc, 0.25) AS q1, median(roc_auc) AS median,
  quantile_cont(roc_auc, 0.75) AS q3 FROM wide GROUP BY model) USING (model) GROUP BY model, q1, median, q3"""


def summary_sql(source, value):
    stats = {"mean": "avg", "sd": "stddev_samp", "median": "median", "min": "min", "max": "max"}
    return cols(
        f"round_even({f}({value}) FILTER (metric = '{m}'), 6) AS {s}_{m}" for m in METRICS for s, f in stats.items()
    ) + f" FROM {source}"


SQL["metric_summary"] = f"SELECT model, {summary_sql('met', 'estimate')} GROUP BY GROUPING SETS ((model), ())"
SQL["best_metric_summary"] = f"SELECT {summary_sql('bestlong', 'value')}"
SQL["metric_median"] = "SELECT metric, round_even(median(value), 6) AS median FROM bestlong GROUP BY metric"
SQL["group_mean_column"] = """SELECT account_id, model, metric, value,
 round_even(avg(value) OVER (PARTITION BY metric), 6) AS mean FROM bestlong"""


def prevalence_sql(source, keys):
    by = cols(keys)
    order = ", model" if "model" in keys else ""
    return f"""SELECT {by}, n, prop_n, label, feature_group, CAST(row_number() OVER (PARTITION BY feature_group
  ORDER BY prop_n DESC NULLS LAST, variable{order}) AS INT) AS display_rank
 FROM (SELECT *, {group_sql("label")} AS feature_group
  FROM (SELECT {by}, count(*) AS n, {share("count(*)", f"(SELECT count(DISTINCT account_id) FROM {source})", 2)}
    AS prop_n, {label_sql("variable", "individual")} AS label FROM {source} GROUP BY {by}))"""


SQL["importance_prevalence"] = prevalence_sql("top10", ["variable", "model"])
SQL["best_importance_prevalence"] = prevalence_sql("bestimp", ["variable"])
SQL["metrics_wide"] = f"SELECT account_id, model, {cols(METRICS)} FROM wide"
SQL["metrics_long"] = "SELECT account_id, model, metric, value FROM bestlong"
SQL["distinct_accounts"] = "SELECT DISTINCT account_id FROM clean"
SQL["metric_thresholds"] = f"""SELECT metric, {case("metric", {a: f"'{b}'" for a, b in METRIC_LABELS.items()})} AS label,
 least AS threshold, round_even(median(value), 6) AS median, {share("count(*) FILTER (value >= least)", "count(value)")}
  AS share_acceptable
 FROM (SELECT *, {case("metric", {"accuracy": "0.7::DOUBLE", "sens": "0.7::DOUBLE", "spec": "0.5::DOUBLE",
                                  "roc_auc": "0.5::DOUBLE"})} AS least FROM bestlong) GROUP BY metric, least"""
SQL["event_nr"] = f"SELECT {ID}, event_nr FROM clean"
SQL["prior_event_lapse"] = f"SELECT {ID}, craving_did_smoke, prior_event_lapse FROM clean"
SQL["mins_since_prev"] = f"SELECT {ID}, mins_since_prev_rep FROM clean"
SQL["next_event_lapse"] = f"SELECT {ID}, craving_did_smoke, next_event_lapse FROM clean"
SQL["entries_window"] = f"SELECT {ID}, n_entries, n_lapses FROM clean"
SQL["lapse_rate_window"] = f"""SELECT {ID}, n_entries, {share("n_lapses", "n_entries")} AS prop_lapses,
 {share("n_entries - n_lapses", "n_entries")} AS prop_non_lapses FROM clean"""
SQL["first_entry"] = f"SELECT {ID}, {T}, cigs_per_day FROM clean WHERE event_nr = 1"
SQL["share_of_total"] = tabulate("clean", "time_of_day").replace("AS percent", "AS prop")
SQL["best_model_per_account"] = f"SELECT account_id, model, {cols(METRICS)} FROM best"
SQL["best_model_counts"] = tabulate("best", "model")
SQL["rank_models"] = f"""SELECT account_id, model, {cols(METRICS)}, CAST(row_number() OVER (PARTITION BY account_id
 ORDER BY {RANKING}, {model_order(["xgb", "svm", "elnet", "rf"])}) AS INT) AS model_rank FROM wide"""
SQL["top_features"] = "SELECT account_id, variable, model, importance, rank FROM top10"
SQL["combine_curves"] = f"""SELECT {case("model", {a: f"'{b}'" for a, b in MODEL_LABELS.items()})} AS model,
 {case("model", {m: i + 1 for i, m in enumerate(MODEL_LABELS)})}::BIGINT AS model_order,
 round_even(1 - specificity, 6) AS false_positive_rate, sensitivity FROM ({curve("pred", ["model"])})"""
SQL["union_roles"] = f"""SELECT {ID}, craving_did_smoke, nullif(role, 'testing') AS role FROM hyb"""
SQL["train_test_split"] = f"SELECT {ID}, split FROM split"
SQL["stratified_split"] = f"""SELECT {ID}, craving_did_smoke, CASE WHEN draw_rank <= floor(0.8::DOUBLE * draw_n)
 THEN 'training' ELSE 'testing' END AS split FROM {ranked("c20", ["account_id", "craving_did_smoke"], "555")}"""
SQL["kfold"] = f"""SELECT {ID}, CAST((draw_rank - 1) % 10 AS INT) AS fold
 FROM {ranked("(SELECT * FROM split WHERE split = 'training')", [], "555:fold")}"""
SQL["downsample"] = f"""SELECT {ID}, craving_did_smoke FROM {ranked("c20", ["craving_did_smoke"], "555:down")}
 WHERE draw_rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c20 GROUP BY craving_did_smoke))"""


def upsample_sql(keys):
    by = "".join(f"{k}, " for k in keys)
    on = " AND ".join([f"b.{k} = s.{k}" for k in keys] + ["true"])
    key_text = "".join(f"s.{k}, ':', " for k in keys)
    return f"""SELECT {ID}, craving_did_smoke, draw FROM (
  SELECT r.*, r.draw_rank AS draw FROM rk r WHERE draw_n = most
  UNION ALL
  SELECT r.*, d.draw FROM (SELECT {cols([f"s.{k}" for k in keys] + ["s.cls"])}, b.draw_rank AS draw,
    ('0x' || substr(md5(concat('555:pick:', {key_text} s.cls, ':', CAST(b.draw_rank AS VARCHAR))), 1, 12))::BIGINT
     % s.n + 1 AS pick
   FROM rk b JOIN (SELECT DISTINCT {by} craving_did_smoke AS cls, draw_n AS n FROM rk WHERE draw_n < most) s
    ON {on} WHERE b.draw_n = b.most) d
  JOIN rk r ON {" AND ".join([f"r.{k} = d.{k}" for k in keys] + ["r.craving_did_smoke = d.cls"])}
   AND r.draw_rank = d.pick)"""


def upsample_ctes(keys):
    part = f"PARTITION BY {cols(keys)}" if keys else ""
    return f"""WITH rk AS (SELECT *, max(draw_n) OVER ({part}) AS most
 FROM {ranked("c20", [*keys, "craving_did_smoke"], "555:up")}) {upsample_sql(keys)}"""


SQL["hybrid_split"] = f"SELECT {ID}, role FROM hyb"
SQL["hybrid_split_40"] = f"SELECT {ID}, role FROM ({hybrid(0.4)})"
SQL["dummy_encode"] = f"SELECT {ID}, {cols(f'{x} AS {n}' for n, x in indicators(NOMINAL).items())} FROM c20"
# Integer polynomial contrasts of seven levels and their norms.
_POLY = [
    ([-3, -2, -1, 0, 1, 2, 3], 28), ([5, 0, -3, -4, -3, 0, 5], 84), ([-1, 1, 1, 0, -1, -1, 1], 6),
    ([3, -7, 1, 6, 1, -7, 3], 154), ([-1, 4, -5, 0, 5, -4, 1], 84), ([1, -6, 15, -20, 15, -6, 1], 924),
]
SQL["poly_contrast"] = f"""SELECT {ID}, {cols(
    f"round_even({case('wkday_craving', dict(zip(LEVELS['wkday_craving'], xs)))} / sqrt({norm}), 6) AS wkday_craving_{d}"
    for d, (xs, norm) in enumerate(_POLY, 1))} FROM c20"""
_N = [f"coalesce({c}, 0)" for c in NUMERIC]
SQL["normalize"] = f"""SELECT {ID}, {cols(
    f"round_even(({x} - m_{c}) / s_{c}, 6) AS {c}" for c, x in zip(NUMERIC, _N))} FROM c20,
 (SELECT {cols(f"avg({x}) AS m_{c}, stddev_samp({x}) AS s_{c}" for c, x in zip(NUMERIC, _N))}
  FROM split WHERE split = 'training')"""
SQL["recipe_statistics"] = f"""SELECT fold, variable, round_even(mean, 6) AS mean, round_even(sd, 6) AS sd
 FROM (SELECT held AS fold, unnest({NUMERIC}) AS variable, unnest([{cols(f"avg({x})" for x in _N)}]) AS mean,
   unnest([{cols(f"stddev_samp({x})" for x in _N)}]) AS sd
  FROM {ranked("(SELECT * FROM split WHERE split = 'training')", [], "555:fold")},
   (SELECT unnest(range(-1, 10))::INT AS held) WHERE (draw_rank - 1) % 10 != held GROUP BY held)"""
SQL["drop_zero_variance"] = f"SELECT {ID}, {cols(FLAGS)} FROM c20"


def roles_sql(moved):
    held = f"""SELECT account_id, CAST((draw_rank - 1) % 10 AS INT) AS holdout
   FROM {ranked("(SELECT DISTINCT account_id FROM c20)", [], "555:holdout", "account_id")}"""
    return f"""SELECT holdout, role, craving_did_smoke, CAST(count(*) FILTER (used) AS BIGINT) AS n
 FROM (SELECT g.holdout, r.role, c.craving_did_smoke,
   CASE r.role WHEN 'testing' THEN h.holdout = g.holdout AND NOT {moved}
    ELSE h.holdout != g.holdout OR {moved} END AS used
  FROM (SELECT * FROM hyb) c JOIN ({held}) h USING (account_id), (SELECT unnest(range(10))::INT AS holdout) g,
   (SELECT unnest(['training', 'testing']) AS role) r) GROUP BY ALL"""


SQL["holdout_roles"] = roles_sql("false")
SQL["holdout_roles_hybrid"] = roles_sql("c.role = 'training'")
SQL["zero_variance"] = f"""SELECT account_id, unnest({[f"{c}_true" for c in FLAGS] + ["cigs_per_day"]}) AS variable,
 unnest([{cols(f"count(DISTINCT {c}) = 1" for c in FLAGS + ["cigs_per_day"])}]) AS constant
 FROM c20 GROUP BY account_id"""
SQL["class_metrics"] = class_metrics("pred", ["model"])
SQL["roc_auc"] = "SELECT account_id, model, auc FROM auc"
SQL["auc_ci"] = f"SELECT * FROM ({pairwise_auc('pred', ['model'])})"
SQL["auc_ci_by_account"] = "SELECT * FROM auc"
SQL["auc_auto_direction"] = """SELECT account_id, model,
 CASE WHEN med_pos < med_neg THEN 1 - auc ELSE auc END AS auc
 FROM auc JOIN (SELECT account_id, model, median(score) FILTER (label = 1) AS med_pos,
  median(score) FILTER (label = 0) AS med_neg FROM pred GROUP BY account_id, model) USING (account_id, model)"""
SQL["roc_curve"] = f"""SELECT model, round_even(threshold, 6) AS threshold, specificity, sensitivity
 FROM ({curve("pred", ["model"])})"""
SQL["auc_summary"] = """SELECT round_even(min(auc), 6) AS min, round_even(median(auc), 6) AS median,
 round_even(max(auc), 6) AS max FROM auc WHERE model = 'rf'"""
SQL["collect_metrics"] = "SELECT model, param_id, metric, mean, n, std_err FROM collected"
SQL["select_best"] = """SELECT model, param_id, metric, mean, n, std_err FROM (SELECT *, row_number() OVER
 (PARTITION BY model ORDER BY mean DESC NULLS LAST, param_id) AS rn FROM collected WHERE metric = 'roc_auc') WHERE rn = 1"""


# Columns that are rounded as the last step of a twin; other twins round where they divide.
_ROUNDED = {
    "class_metrics": ["sens", "spec", "accuracy"], "roc_auc": ["auc"], "auc_ci": ["auc", "ci_lower", "ci_upper"],
    "auc_ci_by_account": ["auc", "ci_lower", "ci_upper"], "auc_auto_direction": ["auc"],
    "roc_curve": ["specificity", "sensitivity"], "roc_panels": ["specificity", "sensitivity"],
    "combine_curves": ["sensitivity"], "metrics_wide": METRICS, "best_model_per_account": METRICS,
    "rank_models": METRICS, "metrics_long": ["value"], "group_mean_column": ["value"], "keep_metrics": ["estimate"],
    "model_names": ["estimate"], "combine_algorithms": MODELS, "rename_cols": ["group_auc"], "tag_column": ["auc"],
    "compare_to_group": ["model_auc", "group_auc"], "collect_metrics": ["mean", "std_err"],
    "select_best": ["mean", "std_err"], "time_diff": ["mins", "hours", "days", "weeks"],
}


def oracles():
    out = {name: with_ctes(rnd(body, _ROUNDED[name]) if name in _ROUNDED else body) for name, body in SQL.items()}
    for name, args in _HIST.items():
        out[name] = with_ctes(histogram_sql(*args))
    for name, keys in (("upsample", []), ("upsample_by_account", ["account_id"])):
        out[name] = with_ctes(upsample_ctes(keys))
    return out
