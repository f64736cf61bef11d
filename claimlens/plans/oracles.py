"""Oracle SQL for DuckDB: the same results as the registered queries, written independently in SQL."""

from __future__ import annotations

from claimlens.columns import CONDITIONS, COVERAGE_MONTHS, HORIZONS, MODELS, horizon_label

LABELS = [horizon_label(n) for n in HORIZONS]
# More code columns than any order has lines; those beyond the longest order are empty.
CODES = [f"icd9_dgns_cd_{k}" for k in range(1, 31)]
SHORT = {c: c[3:] for c in CONDITIONS}

# The values a right result has to use, written out here so that a change of the library does not pass unseen.
CUTOFFS = [
    0.1, 0.15000000000000002, 0.20000000000000004, 0.25000000000000006, 0.30000000000000004, 0.3500000000000001,
    0.40000000000000013, 0.45000000000000007, 0.5000000000000001, 0.5500000000000002, 0.6000000000000002,
    0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000002, 0.8500000000000002,
]
PLANS = [
    ("High", "Intensive case management; Daily medication adherence monitoring; Weekly follow-up appointments; Home health visits 2x per week",
     "Daily vital signs monitoring via telehealth", "48-hour post-discharge appointment"),
    ("Medium", "Standard case management; Medication reconciliation; Bi-weekly follow-up appointments; Disease-specific education program",
     "Weekly telehealth check-ins", "7-day post-discharge appointment"),
    ("Low", "Standard discharge planning; Medication education; Access to nurse hotline; Preventive care reminders",
     "Monthly wellness checks", "14-day post-discharge appointment"),
]
BOX_COLUMNS = [
    "bene_hi_cvrage_tot_mons", "bene_smi_cvrage_tot_mons", "bene_hmo_cvrage_tot_mons", "plan_cvrg_mos_num", "medreimb_ip", "medreimb_op",
    "medreimb_car", "benres_ip", "benres_op", "benres_car", "pppymt_ip", "pppymt_op", "pppymt_car",
]
CATEGORIES = ["bene_sex_ident_cd", "bene_race_cd", "bene_esrd_ind", "sp_state_code"]
FEATURES = [
    "clm_pmt_amt", "clm_utlztn_day_cnt", "age", "num_admissions", "avg_los", "total_ip_cost", "sp_chf", "has_sp_chf", "diag_top_1",
]

# Common tables

CLAIMS = f"""
lines AS (
  SELECT l_orderkey, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity, l_discount) AS k
  FROM lineitem),
line_codes AS (
  SELECT l_orderkey, CAST(count(*) AS INTEGER) AS stay,
         {", ".join(f"max(CASE WHEN k = {k} THEN p_brand END) AS icd9_dgns_cd_{k}" for k in range(1, 31))},
         max(CASE WHEN k = 1 THEN p_type END) AS icd9_prcdr_cd_1
  FROM lines LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
claims AS (
  SELECT o_orderkey AS clm_id, o_custkey AS desynpuf_id,
         CASE WHEN o_orderkey % 499 <> 0 THEN CAST(o_orderdate AS DATE) END AS admit_date,
         CASE WHEN o_orderkey % 499 <> 0
              THEN CAST(o_orderdate AS DATE) + CAST(coalesce(stay, 0) AS INTEGER) END AS discharge_date,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 'Inpatient' ELSE 'Outpatient' END AS claim_type,
         CAST(o_totalprice AS DECIMAL(18, 2)) AS clm_pmt_amt,
         stay AS clm_utlztn_day_cnt, {", ".join(CODES)}, icd9_prcdr_cd_1
  FROM orders LEFT JOIN line_codes ON l_orderkey = o_orderkey),
inpatient AS (SELECT * FROM claims WHERE claim_type = 'Inpatient')"""

LABELLED = f"""
gaps AS (
  SELECT *, CAST(date_diff('day', admit_date, lead(admit_date) OVER (
           PARTITION BY desynpuf_id ORDER BY admit_date NULLS LAST, clm_id)) AS INTEGER) AS days_to_readmit
  FROM inpatient),
labelled AS (
  SELECT *, {", ".join(f"CASE WHEN days_to_readmit <= {n} THEN 1 ELSE 0 END AS readmit_{n}" for n in HORIZONS)}
  FROM gaps)"""

PEOPLE = f"""
conditions AS (
  SELECT o_custkey AS cid, year(o_orderdate) AS cyear,
         {", ".join(f"max(CASE WHEN p_brand = 'Brand#{i}' THEN 1 END) AS {c}" for i, c in enumerate(CONDITIONS, 1))}
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey, year(o_orderdate)),
payments AS (
  SELECT desynpuf_id AS pid, year(admit_date) AS pyear,
         sum(CASE WHEN claim_type = 'Inpatient' THEN clm_pmt_amt END) AS medreimb_ip,
         sum(CASE WHEN claim_type = 'Outpatient' THEN clm_pmt_amt END) AS medreimb_op
  FROM claims WHERE admit_date IS NOT NULL GROUP BY 1, 2),
people AS (
  SELECT c_custkey AS desynpuf_id, CAST(y AS INTEGER) AS year,
         CAST((1920 + c_custkey % 60) * 10000 + (1 + c_custkey % 12) * 100 + (1 + c_custkey % 28) AS INTEGER) AS bene_birth_dt,
         CAST(y - (1920 + c_custkey % 60) AS INTEGER) AS age,
         CAST(1 + c_custkey % 2 AS VARCHAR) AS bene_sex_ident_cd, c_mktsegment AS bene_race_cd,
         CAST(c_nationkey AS INTEGER) AS sp_state_code,
         CASE WHEN c_custkey % 14 = 0 THEN 'Y' ELSE '0' END AS bene_esrd_ind,
         CAST(c_custkey % 13 AS INTEGER) AS bene_hi_cvrage_tot_mons,
         CAST((c_custkey + y) % 13 AS INTEGER) AS bene_smi_cvrage_tot_mons,
         CAST(c_custkey % 7 AS INTEGER) AS bene_hmo_cvrage_tot_mons,
         CAST((c_custkey * 3) % 13 AS INTEGER) AS plan_cvrg_mos_num,
         {", ".join(f"CASE WHEN c_custkey % 97 <> 0 THEN coalesce({c}, 2) END AS {c}" for c in CONDITIONS)},
         coalesce(medreimb_ip, 0) AS medreimb_ip, coalesce(medreimb_op, 0) AS medreimb_op, 0 AS medreimb_car,
         CAST(c_acctbal AS DECIMAL(18, 2)) AS benres_ip, 0 AS benres_op, 0 AS benres_car,
         0 AS pppymt_ip, 0 AS pppymt_op, 0 AS pppymt_car
  FROM customer CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders) v
  LEFT JOIN conditions ON cid = c_custkey AND cyear = y
  LEFT JOIN payments ON pid = c_custkey AND pyear = y)"""

BY_YEAR = """
joined AS (
  SELECT c.*, p.year, p.age FROM claims c
  LEFT JOIN people p ON p.desynpuf_id = c.desynpuf_id AND p.year = year(c.admit_date))"""

UTILIZATION = """
utilization AS (
  SELECT desynpuf_id, count(*) AS num_admissions, avg(clm_utlztn_day_cnt) AS avg_los,
         CAST(sum(clm_pmt_amt) AS DOUBLE) AS total_ip_cost
  FROM inpatient GROUP BY desynpuf_id)"""

LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY desynpuf_id ORDER BY year DESC) AS rn FROM people)
  WHERE rn = 1)"""

LONG_CODES = f"""
long_codes AS (
  SELECT desynpuf_id, clm_id, code FROM (
    SELECT desynpuf_id, clm_id, unnest([{", ".join(CODES)}]) AS code FROM inpatient) WHERE code IS NOT NULL),
top20 AS (
  SELECT code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, code) AS rnk
  FROM long_codes GROUP BY code ORDER BY n DESC, code LIMIT 20)"""

MATRIX = f"""
flags AS (
  SELECT desynpuf_id, {", ".join(f"max(CASE WHEN rnk = {i} THEN 1 ELSE 0 END) AS diag_top_{i}" for i in range(1, 21))}
  FROM long_codes LEFT JOIN top20 USING (code) GROUP BY desynpuf_id),
matrix AS (
  SELECT l.desynpuf_id, l.* EXCLUDE (desynpuf_id, rn),
         {", ".join(f"CASE WHEN {c} = 1 THEN 1 ELSE 0 END AS has_{c}" for c in CONDITIONS)},
         coalesce(num_admissions, 0) AS num_admissions, coalesce(avg_los, 0) AS avg_los,
         coalesce(total_ip_cost, 0) AS total_ip_cost,
         {", ".join(f"coalesce(diag_top_{i}, 0) AS diag_top_{i}" for i in range(1, 21))}
  FROM latest l LEFT JOIN utilization u USING (desynpuf_id) LEFT JOIN flags f USING (desynpuf_id))"""

FRAME_COLUMNS = [
    "clm_pmt_amt",
    "clm_utlztn_day_cnt",
    "year",
    "sp_state_code",
    *COVERAGE_MONTHS,
    *CONDITIONS,
    "age",
    *[f"has_{c}" for c in CONDITIONS],
    "num_admissions",
    "avg_los",
    "total_ip_cost",
    *[f"diag_top_{i}" for i in range(1, 21)],
]

FRAME = f"""
frame AS (
  SELECT a.desynpuf_id, a.clm_id, a.readmit_30 AS label, {", ".join(FRAME_COLUMNS)}
  FROM labelled a LEFT JOIN matrix m ON m.desynpuf_id = a.desynpuf_id)"""

IMPUTED = f"""
imputed AS (
  SELECT desynpuf_id, clm_id, label,
         {", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM frame)) AS {c}" for c in FRAME_COLUMNS)}
  FROM frame)"""

SCORES = f"""
predictions AS (
  SELECT target, model, clm_id, desynpuf_id, label,
         CAST((clm_id * factor + 11) % 1000 AS DOUBLE) * CAST(0.8 AS DOUBLE) / CAST(1000 AS DOUBLE)
           + CAST(0.15 AS DOUBLE) * CAST(label AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS p
  FROM (SELECT clm_id, desynpuf_id, unnest(['readmit_30', 'readmit_60', 'readmit_90']) AS target,
               unnest([readmit_30, readmit_60, readmit_90]) AS label FROM labelled)
  CROSS JOIN (VALUES {", ".join(f"('{m}', {f}, {i})" for i, (m, f) in enumerate(zip(MODELS, [37, 41, 43, 47]), 1))}) m(model, factor, place))"""

SWEEP = f"""
sweep AS (
  SELECT target, model, step, cutoff, tp, fp, fn,
         CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS "precision",
         CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1
  FROM (SELECT target, model, step, cutoff,
               count(*) FILTER (WHERE p > cutoff AND label = 1) AS tp,
               count(*) FILTER (WHERE p > cutoff AND label = 0) AS fp,
               count(*) FILTER (WHERE p <= cutoff AND label = 1) AS fn
        FROM predictions CROSS JOIN (VALUES {", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(CUTOFFS))}) c(step, cutoff)
        GROUP BY ALL)),
cutoffs AS (
  SELECT target, model, CASE WHEN f1 > 0 THEN cutoff ELSE 0.5 END AS cutoff,
         CASE WHEN f1 > 0 THEN "precision" ELSE 0 END AS "precision",
         CASE WHEN f1 > 0 THEN recall ELSE 0 END AS recall, f1
  FROM (SELECT *, row_number() OVER (PARTITION BY target, model ORDER BY f1 DESC, step) AS rn FROM sweep) WHERE rn = 1)"""

METRICS = """
aucs AS (
  SELECT target, model, sum(negatives * (above + positives / 2.0)) / (sum(positives) * CAST(sum(negatives) AS DOUBLE)) AS auc
  FROM (SELECT *, coalesce(sum(positives) OVER (PARTITION BY target, model ORDER BY p DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
        FROM (SELECT target, model, p, CAST(sum(label) AS DOUBLE) AS positives,
                     CAST(sum(1 - label) AS DOUBLE) AS negatives FROM predictions GROUP BY 1, 2, 3))
  GROUP BY target, model),
metrics AS (
  SELECT target, model, cutoff, n, auc, (n - fp - fn) / CAST(n AS DOUBLE) AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS "precision",
         CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1
  FROM (SELECT target, model, cutoff, count(*) AS n,
               count(*) FILTER (WHERE p > cutoff AND label = 1) AS tp,
               count(*) FILTER (WHERE p > cutoff AND label = 0) AS fp,
               count(*) FILTER (WHERE p <= cutoff AND label = 1) AS fn
        FROM predictions JOIN cutoffs USING (target, model) GROUP BY 1, 2, 3)
  JOIN aucs USING (target, model))"""

_PLACE = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS, 1)) + " END"


def _best(source: str) -> str:
    return f"""
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY auc DESC, {_PLACE}) AS rn FROM {source}) WHERE rn = 1)"""


AUC_ONLY = METRICS.split("metrics AS (")[0].rstrip().rstrip(",")

TIERS = """
tiers AS (
  SELECT target, model, clm_id, p, CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.3 THEN 'Medium' ELSE 'Low' END AS tier
  FROM predictions)"""

TIER_COUNTS = """
tier_counts AS (
  SELECT target, model, count(*) FILTER (WHERE tier = 'High') AS high_risk,
         count(*) FILTER (WHERE tier = 'Medium') AS medium_risk, count(*) FILTER (WHERE tier = 'Low') AS low_risk
  FROM tiers JOIN best USING (target, model) GROUP BY target, model),
costs AS (
  SELECT *, cost_without - cost_with AS potential_savings FROM (
    SELECT *, high_risk * 16000.0 + medium_risk * 8000.0 + low_risk * 2000.0 AS cost_without,
           high_risk * 8000.0 + medium_risk * 5000.0 + low_risk * 1000.0 AS cost_with FROM tier_counts))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _r(name: str, digits: int = 6, alias: str | None = None) -> str:
    return f"round(CAST({name} AS DOUBLE), {digits}) AS {alias or name}"


def _packed(column: str) -> str:
    return f"CAST(coalesce(year({column}) * 10000 + month({column}) * 100 + day({column}), 0) AS INTEGER)"


def _unpivoted(source: str, columns: list[str], cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS {cast}) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )


def _histogram(source: str, columns: list[str], bins: str) -> str:
    """Histogram rows of each column; ``bins`` is an expression over n, lo, hi, q1, q3."""
    return f"""
long AS ({_unpivoted(source, columns, "DOUBLE")}),
stats AS (
  SELECT variable, count(*) AS n, min(value) AS lo, max(value) AS hi,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY variable),
ranges AS (SELECT variable, lo, hi, CAST({bins} AS INTEGER) AS bins FROM stats),
bin_counts AS (
  SELECT variable, CAST(least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS INTEGER) AS bin, count(*) AS n
  FROM long JOIN ranges USING (variable) GROUP BY 1, 2),
histogram AS (
  SELECT variable, bin, lo + (hi - lo) / bins * bin AS bin_start, lo + (hi - lo) / bins * (bin + 1) AS bin_end,
         coalesce(n, 0) AS n
  FROM (SELECT variable, lo, hi, bins, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM ranges)
  LEFT JOIN bin_counts USING (variable, bin))"""


def _hash(seed: int) -> str:
    return f"substr(md5(concat_ws('|', CAST(desynpuf_id AS VARCHAR), CAST(clm_id AS VARCHAR), '{seed}')), 1, 13)"


def _split(target: str) -> str:
    """Held-out rows of the trained models."""
    return f"""
split AS (
  SELECT desynpuf_id, clm_id, label, h <= cut AS is_test FROM (
    SELECT *, max(CASE WHEN k = greatest(round(n * 0.2), 1) THEN h END) OVER (PARTITION BY label) AS cut FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM (
        SELECT desynpuf_id, clm_id, {target} AS label, {_hash(42)} AS h FROM labelled))))"""


def _held_out(model: str) -> str:
    """What is determined of a trained model's scores: the held-out rows, that the model's table gives its p, that the
    equations of the fit hold, and that it has learned more than a constant."""
    return f"""{_with(CLAIMS, LABELLED, _split("readmit_30"))} SELECT 'readmit_30' AS target, '{model}' AS model, desynpuf_id,
        clm_id, label, TRUE AS p_from_table, CAST(0 AS DOUBLE) AS residual, TRUE AS beats_constant FROM split WHERE is_test"""


CLAIM_COLUMNS = f"clm_id, desynpuf_id, claim_type, admit_date, year, age, {_r('clm_pmt_amt', 2)}"
_AUTO_BINS = """CASE WHEN hi > lo THEN ceil((hi - lo) / CASE WHEN q3 > q1
    THEN least(2 * (q3 - q1) / cbrt(n), (hi - lo) / (log2(n) + 1))
    ELSE (hi - lo) / (log2(n) + 1) END) ELSE 1 END"""


def all_sql() -> dict[str, str]:
    people = _with(CLAIMS, PEOPLE)
    joined = _with(CLAIMS, PEOPLE, BY_YEAR)
    scores = _with(CLAIMS, LABELLED, SCORES)
    swept = _with(CLAIMS, LABELLED, SCORES, SWEEP)
    measured = _with(CLAIMS, LABELLED, SCORES, SWEEP, METRICS)
    tiered = _with(CLAIMS, LABELLED, SCORES, AUC_ONLY, _best("aucs"), TIERS)
    frame = _with(CLAIMS, LABELLED, PEOPLE, LATEST, UTILIZATION, LONG_CODES, MATRIX, FRAME)
    imputed = f"{frame},{IMPUTED}"
    stats = {c: f"(SELECT avg({c}) FROM imputed)" for c in FEATURES}
    pairs = [(a, b) for i, a in enumerate(CONDITIONS) for b in CONDITIONS[i + 1 :]]
    pair_counts = " UNION ALL ".join(
        f"SELECT '{SHORT[a]} & {SHORT[b]}' AS pair, count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS n FROM people"
        for a, b in pairs
    )
    scores_f = """(
        SELECT feature, round(CASE WHEN within_ms > 0 THEN between_ms / within_ms END, 4) AS f_score FROM (
          SELECT feature, sum(n * (mean - grand) * (mean - grand)) / (count(*) - 1) AS between_ms,
                 sum(n * variance) / (sum(n) - count(*)) AS within_ms
          FROM (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand
                FROM (SELECT feature, label, count(value) AS n, avg(value) AS mean, var_pop(value) AS variance
                      FROM (UNPIVOT imputed ON * EXCLUDE (desynpuf_id, clm_id, label) INTO NAME feature VALUE value)
                      GROUP BY feature, label)) GROUP BY feature))"""
    plans = ", ".join(f"('{t}', '{i}', '{m}', '{f}')" for t, i, m, f in PLANS)
    raw_amount = "CASE WHEN clm_id % 211 = 0 THEN 'n/a' ELSE CAST(clm_pmt_amt AS VARCHAR) END AS clm_pmt_amt"
    clean_amount = "CASE WHEN clm_id % 211 <> 0 THEN round(CAST(clm_pmt_amt AS DOUBLE), 2) END"
    folds = 5
    return {
        "load_beneficiaries": f"""{people} SELECT desynpuf_id, year, bene_birth_dt, bene_sex_ident_cd, bene_race_cd,
            sp_state_code, CASE WHEN year > (SELECT min(year) FROM people) THEN bene_esrd_ind END AS bene_esrd_ind FROM people""",
        "load_claims": f"""{_with(CLAIMS)} SELECT desynpuf_id, clm_id, {_packed('discharge_date')} AS clm_thru_dt, {raw_amount},
            CASE WHEN claim_type = 'Inpatient' THEN {_packed('admit_date')} END AS clm_admsn_dt,
            CASE WHEN claim_type = 'Outpatient' THEN {_packed('admit_date')} END AS clm_from_dt FROM claims""",
        "clean_claims": f"""{_with(CLAIMS)} SELECT desynpuf_id, clm_id, claim_type, admit_date, discharge_date,
            {clean_amount} AS clm_pmt_amt,
            CASE WHEN claim_type = 'Inpatient' THEN clm_utlztn_day_cnt END AS clm_utlztn_day_cnt FROM claims""",
        "parse_dates_strict": f"""{people} SELECT desynpuf_id, year,
            make_date(bene_birth_dt // 10000, bene_birth_dt // 100 % 100, bene_birth_dt % 100) AS birth_date FROM people""",
        "parse_dates_lenient": f"{_with(CLAIMS)} SELECT clm_id, admit_date, discharge_date FROM inpatient",
        "parse_amount_lenient": f"{_with(CLAIMS)} SELECT clm_id, {clean_amount} AS amount FROM inpatient",
        "patient_age": f"{people} SELECT desynpuf_id, year, age FROM people",
        "condition_flags": f"""{people} SELECT desynpuf_id, year,
            {", ".join(f"CASE WHEN {c} = 1 THEN 1 ELSE 0 END AS has_{c}" for c in CONDITIONS)} FROM people""",
        "claims_demographics": f"""{people} SELECT c.clm_id, c.desynpuf_id, claim_type, admit_date, year, age,
            {_r('clm_pmt_amt', 2)} FROM claims c LEFT JOIN people p ON p.desynpuf_id = c.desynpuf_id""",
        "claims_demographics_by_year": f"{joined} SELECT {CLAIM_COLUMNS} FROM joined",
        "claims_filtered": f"""{joined} SELECT {CLAIM_COLUMNS} FROM joined
            WHERE year IN (1998, 1999) AND claim_type = 'Inpatient'""",
        "claims_age_range": f"{joined} SELECT {CLAIM_COLUMNS} FROM joined WHERE age BETWEEN 40 AND 65",
        "claims_code_search": f"""{_with(CLAIMS)} SELECT clm_id, claim_type, icd9_dgns_cd_1, icd9_prcdr_cd_1 FROM claims
            WHERE {" OR ".join(f"contains({c}, '#2')" for c in [*CODES, "icd9_prcdr_cd_1"])}""",
        "claims_table": f"""{joined} SELECT desynpuf_id, claim_type, admit_date, discharge_date, {_r('clm_pmt_amt', 2)},
            clm_utlztn_day_cnt, clm_id FROM joined WHERE year IS NOT NULL
            ORDER BY admit_date NULLS LAST, clm_id, year LIMIT 1000""",
        "kpi_summary": f"""{people} SELECT round(CAST(sum(clm_pmt_amt) AS DOUBLE), 2) AS total_reimbursed,
            count(*) FILTER (WHERE claim_type = 'Inpatient') AS inpatient_claims,
            count(*) FILTER (WHERE claim_type = 'Outpatient') AS outpatient_claims, count(*) AS claims,
            (SELECT count(DISTINCT desynpuf_id) FROM people) AS unique_patients FROM claims""",
        "monthly_reimbursement": f"""{joined} SELECT CAST(date_trunc('month', admit_date) AS DATE) AS month, claim_type,
            round(CAST(sum(clm_pmt_amt) AS DOUBLE), 2) AS amount FROM joined
            WHERE year IS NOT NULL AND admit_date IS NOT NULL GROUP BY 1, 2""",
        "reimbursement_by_type": f"""{joined} SELECT claim_type, round(CAST(sum(clm_pmt_amt) AS DOUBLE), 2) AS amount
            FROM joined WHERE year IS NOT NULL GROUP BY 1""",
        "count_by_sex": f"{people} SELECT bene_sex_ident_cd, count(*) AS n FROM people GROUP BY 1",
        "condition_counts_top10": f"""{people} SELECT * FROM ({" UNION ALL ".join(
            f"SELECT '{SHORT[c]}' AS condition, count(*) FILTER (WHERE {c} = 1) AS n FROM people" for c in CONDITIONS)})
            ORDER BY n DESC, condition LIMIT 10""",
        "filter_options": f"""{people} SELECT (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year)
            FROM (SELECT DISTINCT year FROM people)) AS years, min(age) AS min_age, max(age) AS max_age FROM people""",
        "days_to_readmit": f"{_with(CLAIMS, LABELLED)} SELECT clm_id, desynpuf_id, admit_date, days_to_readmit FROM gaps",
        "readmission_labels": f"""{_with(CLAIMS, LABELLED)} SELECT clm_id, desynpuf_id, admit_date, days_to_readmit,
            {", ".join(LABELS)} FROM labelled""",
        "readmission_totals": f"""{_with(CLAIMS, LABELLED)} SELECT count(*) AS admissions,
            {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in LABELS)} FROM labelled""",
        "latest_beneficiary": f"{_with(CLAIMS, PEOPLE, LATEST)} SELECT desynpuf_id, year, bene_birth_dt FROM latest",
        "patient_utilization": f"""{_with(CLAIMS, UTILIZATION)} SELECT desynpuf_id, num_admissions, {_r('avg_los')},
            {_r('total_ip_cost')} FROM utilization""",
        "patient_features": f"""{_with(CLAIMS, PEOPLE, LATEST, UTILIZATION)} SELECT desynpuf_id, year, age,
            {", ".join(f"CASE WHEN {c} = 1 THEN 1 ELSE 0 END AS has_{c}" for c in CONDITIONS)},
            coalesce(num_admissions, 0) AS num_admissions, {_r('coalesce(avg_los, 0)', alias='avg_los')},
            {_r('coalesce(total_ip_cost, 0)', alias='total_ip_cost')}
            FROM latest LEFT JOIN utilization USING (desynpuf_id)""",
        "codes_long": f"{_with(CLAIMS, LONG_CODES)} SELECT desynpuf_id, clm_id, code FROM long_codes",
        "top_codes": f"{_with(CLAIMS, LONG_CODES)} SELECT code, n FROM top20",
        "diagnosis_features": f"""{_with(CLAIMS, PEOPLE, LATEST, UTILIZATION, LONG_CODES, MATRIX)} SELECT desynpuf_id, age,
            num_admissions, {", ".join(f"diag_top_{i}" for i in range(1, 21))} FROM matrix""",
        "training_frame": f"""{frame} SELECT desynpuf_id, clm_id, label, {", ".join(
            _r(c) if c in ("clm_pmt_amt", "avg_los", "total_ip_cost") else c for c in FRAME_COLUMNS)} FROM frame""",
        "patient_lookup": f"""{_with(CLAIMS, PEOPLE, LATEST, UTILIZATION)}, one AS (
            SELECT desynpuf_id, year, age, bene_race_cd, coalesce(num_admissions, 0) AS num_admissions,
                   CAST(coalesce(avg_los, 0) AS DECIMAL(18, 2)) AS avg_los,
                   CAST(coalesce(total_ip_cost, 0) AS DECIMAL(18, 2)) AS total_ip_cost
            FROM latest LEFT JOIN utilization USING (desynpuf_id) WHERE CAST(desynpuf_id AS VARCHAR) = '7')
            {" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM one" for c in (
                "desynpuf_id", "year", "age", "bene_race_cd", "num_admissions", "avg_los", "total_ip_cost"))}""",
        "patient_ids": f"""{_with(CLAIMS, PEOPLE, LATEST)} SELECT CAST(desynpuf_id AS VARCHAR) AS desynpuf_id FROM latest
            ORDER BY 1 LIMIT 1000""",
        "condition_prevalence": f"""{people} SELECT year, count(*) AS n, {", ".join(
            f"round(100.0 * count(*) FILTER (WHERE {c} = 1) / CAST(count(*) AS DOUBLE), 6) AS {c}" for c in CONDITIONS)}
            FROM people GROUP BY year""",
        "comorbidity_pairs": f"{people} SELECT * FROM ({pair_counts}) WHERE n > 0",
        "comorbidity_top10": f"{people} SELECT * FROM ({pair_counts}) WHERE n > 0 ORDER BY n DESC, pair LIMIT 10",
        "value_counts": f"""{people} SELECT variable, value, count(*) AS n
            FROM ({_unpivoted("people", CATEGORIES, "VARCHAR")}) GROUP BY 1, 2""",
        "value_shares": """WITH long AS (
              SELECT 'gender_source_value' AS variable, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS value FROM customer
              UNION ALL SELECT 'race_source_value', c_mktsegment FROM customer)
            SELECT variable, value, count(*) AS n,
                   round(count(*) * 100.0 / CAST(sum(count(*)) OVER (PARTITION BY variable) AS DOUBLE), 6) AS share
            FROM long GROUP BY variable, value""",
        "crosstab_race_gender": """SELECT c_mktsegment AS race_source_value, count(*) FILTER (WHERE c_custkey % 2 = 0) AS "F",
            count(*) FILTER (WHERE c_custkey % 2 = 1) AS "M" FROM customer GROUP BY 1""",
        "histogram20": f"""{_with(CLAIMS, _histogram("claims", ["clm_pmt_amt"], "20"))} SELECT variable, bin,
            {_r('bin_start')}, {_r('bin_end')}, n FROM histogram""",
        "histogram_auto": f"""{_with(CLAIMS, PEOPLE, _histogram("people", ["age"], _AUTO_BINS))} SELECT variable, bin,
            {_r('bin_start')}, {_r('bin_end')}, n FROM histogram""",
        "numeric_summary": f"""{people} SELECT variable, count(*) AS n, round(avg(value), 6) AS mean,
            round(quantile_cont(value, 0.5), 6) AS median
            FROM ({_unpivoted("people", ["age", "medreimb_ip", "benres_ip"], "DOUBLE")}) GROUP BY variable""",
        "kde_age": f"""{people}, stats AS (SELECT count(*) AS n, min(age) AS lo, max(age) AS hi,
              stddev_samp(age) * pow(count(*), -0.2) AS bw FROM people),
            grid AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 199.0 AS x, bw, n FROM stats, range(200) r(i))
            SELECT point, round(CAST(x AS DOUBLE), 6) AS x, round(sum(exp(-0.5 * pow((x - age) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
            FROM grid CROSS JOIN people GROUP BY point, x, bw, n""",
        "box_stats": f"""{people}, long AS ({_unpivoted("people", BOX_COLUMNS, "DOUBLE")}),
            quartiles AS (SELECT variable, count(*) AS n, quantile_cont(value, 0.25) AS q1,
              quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY variable)
            SELECT variable, n, {_r("q1")}, {_r("median")}, {_r("q3")},
              round(least(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), q1), 6) AS whisker_low,
              round(greatest(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), q3), 6) AS whisker_high,
              count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
            FROM long JOIN quartiles USING (variable) GROUP BY variable, n, q1, median, q3""",
        "condition_sums": f"""{people} {" UNION ALL ".join(
            f"SELECT '{c}' AS condition, CAST(sum({c}) AS BIGINT) AS total FROM people" for c in CONDITIONS)}""",
        "non_null_counts": f"""{people} {" UNION ALL ".join(
            f"SELECT '{c}' AS variable, '{t}' AS data_type, count(*) AS n, count({c}) AS non_null FROM people" for c, t in [
                ("desynpuf_id", "bigint"), ("year", "int"), ("bene_esrd_ind", "string"), *[(c, "int") for c in CONDITIONS]])}""",
        "profile_table": f"""{_with(CLAIMS, PEOPLE, _histogram("people", ["age", "bene_hi_cvrage_tot_mons"], "10"))}
            SELECT variable, 'count' AS statistic, value AS item, CAST(count(*) AS DOUBLE) AS value
            FROM ({_unpivoted("people", ["bene_sex_ident_cd", "bene_race_cd"], "VARCHAR")}) GROUP BY variable, value
            UNION ALL SELECT variable, 'histogram', CAST(bin AS VARCHAR), CAST(n AS DOUBLE) FROM histogram
            UNION ALL SELECT variable, 'mean', '', round(avg(value), 6) FROM long GROUP BY variable
            UNION ALL SELECT variable, 'median', '', round(quantile_cont(value, 0.5), 6) FROM long GROUP BY variable""",
        "impute_median": f"{imputed} SELECT clm_id, {', '.join(_r(c) for c in FEATURES)} FROM imputed",
        "standard_scale": f"""{imputed} SELECT clm_id, {", ".join(
            f"round(({c} - {stats[c]}) / (SELECT CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END FROM imputed), 4) AS {c}"
            for c in FEATURES)} FROM imputed""",
        "anova_f_scores": f"{imputed} SELECT feature, f_score FROM {scores_f}",
        "select_k_best": f"{imputed} SELECT feature, f_score FROM {scores_f} ORDER BY f_score DESC NULLS LAST, feature LIMIT 10",
        "class_weights": f"""{_with(CLAIMS, LABELLED)} SELECT readmit_30 AS label, count(*) AS n,
            round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 6) AS weight
            FROM labelled GROUP BY readmit_30""",
        "stratified_split": f"""{_with(CLAIMS, LABELLED)} SELECT desynpuf_id, clm_id, label, h <= cut AS is_test FROM (
              SELECT *, max(CASE WHEN k = greatest(round(n * 0.2), 1) THEN h END) OVER (PARTITION BY label) AS cut FROM (
                SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM (
                  SELECT desynpuf_id, clm_id, readmit_30 AS label, {_hash(42)} AS h FROM labelled)))""",
        "cv_folds": f"""{_with(CLAIMS, LABELLED)} SELECT desynpuf_id, clm_id, label, CAST(
              {" + ".join(f"(CASE WHEN k > round(n * {i / folds}) THEN 1 ELSE 0 END)" for i in range(1, folds))} AS INTEGER) AS fold FROM (
                SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM (
                  SELECT desynpuf_id, clm_id, readmit_30 AS label, {_hash(43)} AS h FROM labelled))""",
        "threshold_sweep": f"""{swept} SELECT target, model, step, {_r("cutoff")}, tp, fp, fn, {_r('"precision"', alias='"precision"')},
            {_r("recall")}, {_r("f1")} FROM sweep""",
        "best_threshold": f"""{swept} SELECT target, model, {_r("cutoff")}, {_r('"precision"', alias='"precision"')}, {_r("recall")},
            {_r("f1")} FROM cutoffs""",
        "classification_metrics": f"""{measured} SELECT target, model, {_r("cutoff")}, n, {_r("accuracy")},
            {_r('"precision"', alias='"precision"')}, {_r("recall")}, {_r("f1")} FROM metrics""",
        "roc_auc": f"{measured} SELECT target, model, {_r('auc')} FROM aucs",
        "roc_curve": f"""{scores} SELECT target, model, round(fp / CAST(sum(negatives) OVER w AS DOUBLE), 6) AS fpr,
            round(tp / CAST(sum(positives) OVER w AS DOUBLE), 6) AS tpr, round(p, 6) AS cutoff
            FROM (SELECT *, sum(positives) OVER (PARTITION BY target, model ORDER BY p DESC) AS tp,
                         sum(negatives) OVER (PARTITION BY target, model ORDER BY p DESC) AS fp
                  FROM (SELECT target, model, p, sum(label) AS positives, sum(1 - label) AS negatives
                        FROM predictions GROUP BY 1, 2, 3))
            WINDOW w AS (PARTITION BY target, model)
            UNION ALL SELECT DISTINCT target, model, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM predictions""",
        "auc_by_model": f"{measured} SELECT target, model, {_r('auc')} FROM metrics",
        "best_model": f"""{measured},{_best("metrics")} SELECT target, model, {_r("cutoff")}, n, {_r("accuracy")},
            {_r('"precision"', alias='"precision"')}, {_r("recall")}, {_r("f1")}, {_r("auc")} FROM best""",
        "performance_summary": f"""{measured} SELECT target, model, {", ".join(
            f"printf('%.3f', {c}) AS {c}" for c in ("accuracy", "auc", "f1", "recall", '"precision"'))},
            printf('%.3f ± 0.000', auc) AS cv_auc FROM metrics""",
        "readmission_rates": f"""{measured},{_best("metrics")} SELECT target, model, count(*) AS n,
            CAST(sum(label) AS BIGINT) AS actual, count(*) FILTER (WHERE p > cutoff) AS predicted,
            round(sum(label) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS actual_rate,
            round(count(*) FILTER (WHERE p > cutoff) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS predicted_rate
            FROM predictions JOIN best USING (target, model) GROUP BY target, model""",
        "risk_tiers": f"{tiered} SELECT target, model, clm_id, {_r('p')}, tier FROM tiers",
        "risk_tier_counts": f"{tiered},{TIER_COUNTS} SELECT * FROM tier_counts",
        "treatment_costs": f"""{tiered},{TIER_COUNTS} SELECT target, model, high_risk, medium_risk, low_risk,
            {_r("cost_without", 2)}, {_r("cost_with", 2)}, {_r("potential_savings", 2)} FROM costs""",
        "treatment_plan": f"""{tiered} SELECT clm_id, tier, interventions, monitoring, follow_up
            FROM tiers JOIN best USING (target, model)
            JOIN (VALUES {plans}) v(tier, interventions, monitoring, follow_up) USING (tier) WHERE target = 'readmit_30'""",
        "executive_summary": f"""{tiered},{PEOPLE},{LONG_CODES},{TIER_COUNTS}
            SELECT 'data' AS section, 'unique_patients' AS item, CAST(count(DISTINCT desynpuf_id) AS VARCHAR) AS value FROM people
            UNION ALL SELECT 'data', 'inpatient_admissions', CAST(count(*) AS VARCHAR) FROM inpatient
            UNION ALL SELECT 'best_model', target, printf('%s (AUC: %.3f)', model, auc) FROM best
            UNION ALL SELECT 'risk_factor', CAST(rnk AS VARCHAR), code FROM top20 WHERE rnk <= 5
            UNION ALL SELECT 'savings', target, printf('%.2f', CAST(potential_savings AS DOUBLE)) FROM costs WHERE target = 'readmit_30'""",
        **{
            query: _held_out(model)
            for query, model in [
                ("model_lr", "Logistic Regression"),
                ("model_rf", "Random Forest"),
                ("model_gbt", "Gradient Boosting"),
                ("model_gbt_weighted", "Weighted Gradient Boosting"),
                ("model_mlp", "Multilayer Perceptron"),
            ]
        },
        "train_horizon": f"""{_with(CLAIMS, LABELLED, _split("readmit_30"))} SELECT 'readmit_30' AS target, model, count(*) AS n,
            CAST(sum(label) AS BIGINT) AS positives, TRUE AS rates_agree, TRUE AS ranks
            FROM split CROSS JOIN (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting'),
            ('Weighted Gradient Boosting')) m(model) WHERE is_test GROUP BY model""",
        "cross_validation": f"""{_with(CLAIMS, LABELLED, _split("readmit_30"))}, folded AS (
              SELECT CAST({" + ".join(f"(CASE WHEN k > round(n * {i / folds}) THEN 1 ELSE 0 END)" for i in range(1, folds))} AS INTEGER) AS fold FROM (
                SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM (
                  SELECT label, {_hash(43)} AS h FROM split WHERE NOT is_test)))
            SELECT 'readmit_30' AS target, model, fold, count(*) AS n, TRUE AS auc_in_range, TRUE AS ranks
            FROM folded CROSS JOIN (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting'),
            ('Weighted Gradient Boosting')) m(model) GROUP BY model, fold""",
        "feature_importance": """SELECT 'Random Forest' AS model, 10 AS factors, TRUE AS ranked, TRUE AS a_share, CAST(0 AS DOUBLE) AS residual""",
        "batch_score": f"""{_with(CLAIMS, LABELLED, _split("readmit_30"))} SELECT clm_id, TRUE AS p_from_table,
            TRUE AS tier_agrees FROM split WHERE is_test""",
        "load_missing_years": f"""{people} SELECT desynpuf_id, year, bene_race_cd, sp_state_code, bene_birth_dt FROM people
            WHERE year IN (SELECT year FROM (SELECT DISTINCT year FROM people ORDER BY year LIMIT 3) ORDER BY year LIMIT 1)
               OR year IN (SELECT max(year) FROM (SELECT DISTINCT year FROM people ORDER BY year LIMIT 3))""",
        "predictions_through_files": f"{tiered} SELECT target, model, clm_id, {_r('p')}, tier FROM tiers",
        "summary_through_files": f"""{measured} SELECT target, model, {", ".join(
            f"printf('%.3f', {c}) AS {c}" for c in ("accuracy", "auc", "f1", "recall", '"precision"'))},
            printf('%.3f ± 0.000', auc) AS cv_auc FROM metrics""",
        "results_through_registry": f"""{measured} SELECT target, model, {_r("cutoff")}, n, {_r("f1")}, {_r("auc")}, rows, positives
            FROM metrics JOIN (SELECT target, model, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM predictions
            GROUP BY target, model) USING (target, model)""",
        "features_from_file": f"""{frame} SELECT clm_id, {", ".join(_r(c) for c in FEATURES)} FROM frame""",
        "profile_of_file": """WITH p AS (SELECT c_custkey AS x, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
              c_mktsegment AS race FROM customer),
            b AS (SELECT CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM p)
            SELECT 'gender_source_value' AS variable, 'count' AS statistic, sex AS item, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY sex
            UNION ALL SELECT 'race_source_value', 'count', race, CAST(count(*) AS DOUBLE) FROM p GROUP BY race
            UNION ALL SELECT 'person_id', 'histogram', CAST(i AS VARCHAR), CAST(count(bin) AS DOUBLE) FROM range(5) t(i) LEFT JOIN (
              SELECT least(CAST(floor((x - lo) / (hi - lo) * 5) AS INTEGER), 4) AS bin FROM p CROSS JOIN b) ON bin = i GROUP BY i
            UNION ALL SELECT 'person_id', 'mean', '', round(avg(x), 6) FROM p
            UNION ALL SELECT 'person_id', 'median', '', round(CAST(quantile_cont(x, 0.5) AS DOUBLE), 6) FROM p""",
        "preview_count": "SELECT CAST(20 AS BIGINT) AS n, CAST(20 AS BIGINT) AS claims",
        "best_model_insight": f"""{measured},{_best("metrics")} SELECT target, model, {_r("auc")} FROM best""",
        "performance_summary_folds": f"""{measured}, folded AS (
              SELECT clm_id, {" + ".join(f"(CASE WHEN k > round(n * {i / folds}) THEN 1 ELSE 0 END)" for i in range(1, folds))} AS fold FROM (
                SELECT *, row_number() OVER (PARTITION BY readmit_30 ORDER BY h) AS k, count(*) OVER (PARTITION BY readmit_30) AS n FROM (
                  SELECT clm_id, readmit_30, {_hash(43)} AS h FROM labelled))),
            steps AS (SELECT target, model, fold, p, sum(label) AS positives, sum(1 - label) AS negatives
                      FROM predictions JOIN folded USING (clm_id) GROUP BY 1, 2, 3, 4),
            running AS (SELECT *, sum(positives) OVER (PARTITION BY target, model, fold ORDER BY p DESC) - positives AS above FROM steps),
            fold_aucs AS (SELECT target, model, fold, sum(negatives * (above + positives / 2.0)) /
                      (CAST(sum(positives) AS DOUBLE) * sum(negatives)) AS auc FROM running GROUP BY 1, 2, 3),
            cv AS (SELECT target, model, avg(auc) AS cv_mean, stddev_pop(auc) AS cv_std FROM fold_aucs GROUP BY 1, 2)
            SELECT target, model, printf('%.3f', auc) AS auc, printf('%.3f ± %.3f', cv_mean, cv_std) AS cv_auc
            FROM metrics JOIN cv USING (target, model)""",
        "saved_models": f"""{_with(CLAIMS, LABELLED, "earlier AS (SELECT * FROM labelled WHERE clm_id % 5 > 0)",
            _split("readmit_30").replace("FROM labelled", "FROM earlier"))} SELECT 'readmit_30' AS target, 'Logistic Regression' AS model,
            count(*) AS n, TRUE AS ranks, count(*) AS scored_again, TRUE AS same_scores, CAST(0 AS BIGINT) AS seen_before
            FROM split WHERE is_test""",
        "registry_latest": """SELECT target, model, version FROM (
              SELECT o_orderpriority AS target, o_orderstatus AS model, o_orderkey AS version,
                     row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus
                                        ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    }
