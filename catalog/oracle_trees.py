"""SQL twins of tree fits small enough for SQL: hashed draws, histograms, best cuts, scores, permuted votes."""

from catalog.oracle import cols, hybrid, indicators, pairwise_auc, ranked, with_ctes
from catalog.training import FEW
from diarist.operators.features import NOMINAL
from diarist.operators.trees import PRIME, RIDGE, STEPS, UNIT

_COLUMNS = indicators(NOMINAL) | {"craving_severity": "craving_severity::DOUBLE"}
_VALUES = [_COLUMNS[c] for c in FEW]
_NAMES = "['" + "', '".join(FEW) + "']"


def _tables(trees):
    """Entries by predictor (``fx``), values with their codes and cut points (``val``), and each tree's hash (``own``)."""
    digits = "md5(concat('555:tree:', CAST(tree AS VARCHAR)))"
    return f"""ent AS (SELECT entry_ordinal, account_id, CAST(craving_did_smoke = 'true' AS INT) AS label, [{cols(_VALUES)}] AS vs,
  ('0x' || substr(md5(concat('555:', CAST(entry_ordinal AS VARCHAR))), 1, 12))::BIGINT % {PRIME} AS hashed FROM c20),
 fx AS (SELECT entry_ordinal, label, hashed, unnest(range(5)) AS f, unnest(vs) AS v FROM ent),
 val AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS code, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut
  FROM (SELECT DISTINCT f, v FROM fx)),
 cx AS (SELECT fx.*, code FROM fx JOIN val USING (f, v)),
 own AS (SELECT tree, 1 + ('0x' || substr({digits}, 1, 12))::BIGINT % {PRIME - 1} AS ha, ('0x' || substr({digits}, 13, 12))::BIGINT % {PRIME} AS hb
  FROM (SELECT unnest(range({trees})) AS tree))"""


def _grown(name, weighed, levels, gain, allowed, tried, keep):
    """Tables of the nodes of ``levels`` levels of cuts: ``<name>_at<k>`` where rows are, ``<name>_cut<k>`` the best cuts."""
    out = [f"{name}_at0 AS (SELECT tree, entry_ordinal, wa, wb, n, 1::BIGINT AS node FROM {weighed})"]
    for k in range(levels):
        at, cut = f"{name}_at{k}", f"{name}_cut{k}"
        out.append(f"""{name}_nd{k} AS (SELECT tree, node, sum(wa) AS ta, sum(wb) AS tb FROM {at} GROUP BY ALL),
 {name}_hist{k} AS (SELECT tree, node, f, code, sum(wa) AS a, sum(wb) AS b, sum(n) AS n
  FROM {at} JOIN cx USING (entry_ordinal) JOIN {tried(f"{name}_nd{k}")} USING (tree, node, f) GROUP BY ALL),
 {name}_run{k} AS (SELECT *, ta - la AS ra, tb - lb AS rb FROM (SELECT tree, node, f, code, sum(a) OVER o AS la, sum(b) OVER o AS lb,
   sum(a) OVER w AS ta, sum(b) OVER w AS tb, sum(n) OVER w - sum(n) OVER o AS rest FROM {name}_hist{k}
   WINDOW o AS (PARTITION BY tree, node, f ORDER BY code), w AS (PARTITION BY tree, node, f))),
 {cut} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, code) AS rn
  FROM (SELECT *, {gain} AS gain FROM {name}_run{k} WHERE rest > 0) WHERE {allowed}) WHERE rn = 1 AND {keep}),
 {name}_at{k + 1} AS (SELECT tree, entry_ordinal, wa, wb, n, node * 2 + CAST(cx.code > c.code AS BIGINT) AS node
  FROM {at} JOIN {cut} c USING (tree, node) JOIN cx USING (entry_ordinal, f))""")
    out.append(f"{name}_nd{levels} AS (SELECT tree, node, sum(wa) AS ta, sum(wb) AS tb FROM {name}_at{levels} GROUP BY ALL)")
    return ",\n ".join(out)


def _nodes(name, levels, value, scale=""):
    every = " UNION ALL ".join(
        f"SELECT d.tree, d.node, d.ta, d.tb, {'c.f, c.code' if k < levels else 'NULL AS f, NULL AS code'} FROM {name}_nd{k} d"
        + (f" LEFT JOIN {name}_cut{k} c USING (tree, node)" if k < levels else "") for k in range(levels + 1)
    )
    return f"""SELECT CAST(tree AS INT) AS tree, node, {_NAMES}[f + 1] AS feature, cut AS threshold,
  ta::DOUBLE{scale} AS n0, tb::DOUBLE{scale} AS n1, {value} AS value, f FROM ({every}) LEFT JOIN val USING (f, code)"""


_PICK = f"""(SELECT d.tree, d.node, f, row_number() OVER (PARTITION BY d.tree, d.node ORDER BY h * h % {PRIME}, f) AS nth
   FROM (SELECT d.tree, d.node, f, ((d.node * 5 + f) % {PRIME} * ha + hb) % {PRIME} AS h
    FROM {{0}} d JOIN own USING (tree), (SELECT unnest(range(5)) AS f)) d)"""


def _pick(nodes):
    return f"(SELECT tree, node, f FROM {_PICK.format(nodes)} WHERE nth <= 2)"


def _all(nodes):
    return f"(SELECT tree, node, unnest(range(5)) AS f FROM {nodes})"


_DRAWN = " + ".join(f"CAST((hashed * ha + hb) % {PRIME} >= {s} AS INT)" for s in STEPS)
_GINI = "(la::DOUBLE * la + lb::DOUBLE * lb) / (la + lb) + (ra::DOUBLE * ra + rb::DOUBLE * rb) / (ra + rb)"
_FOREST = f"""{_tables(5)},
 bag AS (SELECT tree, entry_ordinal, label, {_DRAWN} AS n FROM ent, own),
 {_grown("fo", "(SELECT tree, entry_ordinal, n * (1 - label) AS wa, n * label AS wb, n FROM bag WHERE n > 0)", 2, _GINI, "true", _pick,
         "ta + tb > 13 AND ta > 0 AND tb > 0")},
 fnode AS ({_nodes("fo", 2, "CASE WHEN ta + tb > 0 THEN tb::DOUBLE / (ta + tb) ELSE 0.5 END")})"""


def _routed(values):
    """(row keys, tree) with the value of the node where the row ends; ``values`` has lists ``vs`` of the predictors."""
    step = "n.node * 2 + CAST(vs[n.f + 1] > n.threshold AS BIGINT)"
    return f"""(SELECT r.* EXCLUDE (at1, f), m.value FROM (SELECT r.* EXCLUDE (at0), at0, CASE WHEN n.f IS NULL THEN at0 ELSE {step} END AS at1, n.f
   FROM (SELECT *, 1::BIGINT AS at0 FROM {values}) r JOIN fnode n ON n.tree = r.tree AND n.node = at0) r
  JOIN fnode n1 ON n1.tree = r.tree AND n1.node = r.at1
  JOIN fnode m ON m.tree = r.tree AND m.node = CASE WHEN n1.f IS NULL THEN r.at1 ELSE r.at1 * 2 + CAST(vs[n1.f + 1] > n1.threshold AS BIGINT) END)"""


_VOTES = f"""dr AS (SELECT e.*, draw_rank, draw_n FROM {ranked("ent", [], "555:permute")} q JOIN ent e USING (entry_ordinal)),
 pair AS (SELECT a.entry_ordinal, a.label, a.vs, b.vs AS ys FROM dr a JOIN dr b ON (b.draw_rank - 2 + b.draw_n) % b.draw_n + 1 = a.draw_rank),
 swapped AS (SELECT tree, entry_ordinal, label, j, [{cols(f"CASE WHEN j = {i} THEN ys[{i + 1}] ELSE vs[{i + 1}] END" for i in range(5))}] AS vs
  FROM pair JOIN bag USING (entry_ordinal, label), (SELECT unnest(range(-1, 5)) AS j) WHERE bag.n = 0),
 vote AS (SELECT tree, j, count(*) AS n, count(*) FILTER ((value > 0.5) = (label = 1)) AS ok FROM {_routed("swapped")} GROUP BY ALL)"""

ORACLE = {
    "forest_shallow": f"WITH {_FOREST} SELECT * EXCLUDE (f) REPLACE (round_even(value, 6) AS value) FROM fnode",
    "forest_shallow_scores": f"""WITH {_FOREST} SELECT entry_ordinal, label, round_even(sum(value) / 5, 6) AS score
 FROM {_routed("(SELECT entry_ordinal, label, vs, tree FROM ent, own)")} GROUP BY ALL""",
    "forest_shallow_oob_importance": f"""WITH {_FOREST}, {_VOTES}
 SELECT {_NAMES}[p.j + 1] AS variable, round_even(sum((b.ok - p.ok)::DOUBLE / b.n) / 5, 6) AS importance
 FROM vote p JOIN vote b ON b.tree = p.tree AND b.j = -1 WHERE p.j >= 0 GROUP BY p.j""",
}



def _held_out(moved):
    """Forests of five trees for each account, of the entries of all others (and the account's own that are ``moved``)."""
    tables = _tables("(SELECT 5 * count(DISTINCT account_id) FROM c20)")
    goal = "max(n)" if moved == "false" else "min(n)"
    return f"""WITH {tables},
 acc AS (SELECT account_id, draw_rank - 1 AS h FROM {ranked("(SELECT DISTINCT account_id FROM c20)", [], "555:holdout", "account_id")}),
 hent AS (SELECT e.*, h, {moved} AS moved FROM ent e JOIN (SELECT entry_ordinal, role FROM ({hybrid(0.2)})) q USING (entry_ordinal) JOIN acc USING (account_id)),
 cls AS (SELECT a.h, t.label, t.n - coalesce(o.n, 0) AS n FROM acc a CROSS JOIN (SELECT label, count(*) AS n FROM ent GROUP BY label) t
  LEFT JOIN (SELECT h, label, count(*) FILTER (NOT moved) AS n FROM hent GROUP BY h, label) o ON o.h = a.h AND o.label = t.label),
 mean AS (SELECT h, label, CASE WHEN min(n) OVER (PARTITION BY h) > 0 THEN {goal} OVER (PARTITION BY h) / n::DOUBLE ELSE 1 END AS m FROM cls),
 thr AS (SELECT h, label, floor(sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY h, label ORDER BY k) * {PRIME}) AS bound
  FROM mean, (SELECT unnest(range(200)) AS k) WHERE k < 20 + 10 * m),
 bag AS (SELECT tree, e.entry_ordinal, e.label, count(*) AS n FROM own JOIN hent e ON e.h != tree // 5 OR e.moved
  JOIN thr ON thr.h = tree // 5 AND thr.label = e.label AND bound <= (hashed * ha + hb) % {PRIME} GROUP BY ALL),
 {_grown("fo", "(SELECT tree, entry_ordinal, n * (1 - label) AS wa, n * label AS wb, n FROM bag)", 2, _GINI, "true", _pick,
         "ta + tb > 13 AND ta > 0 AND tb > 0")},
 fnode AS ({_nodes("fo", 2, "CASE WHEN ta + tb > 0 THEN tb::DOUBLE / (ta + tb) ELSE 0.5 END")}),
 hs AS (SELECT entry_ordinal, account_id, label, round_even(sum(value) / 5, 9) AS score
  FROM {_routed("(SELECT e.*, tree FROM hent e JOIN own ON tree // 5 = h WHERE NOT moved)")} GROUP BY ALL)
 SELECT * REPLACE (round_even(auc, 6) AS auc, round_even(ci_lower, 6) AS ci_lower, round_even(ci_upper, 6) AS ci_upper)
 FROM ({pairwise_auc("hs", ["account_id"])})"""


ORACLE["group_to_individual"] = _held_out("false")
ORACLE["hybrid_to_individual"] = _held_out("role = 'training'")
_G = f"{UNIT}.0::DOUBLE"
_LA, _LB, _RA, _RB = (f"({c} / {_G})" for c in ("la", "lb", "ra", "rb"))
_GAIN = (f"{_LA} * {_LA} / ({_LB} + {RIDGE}::DOUBLE) + {_RA} * {_RA} / ({_RB} + {RIDGE}::DOUBLE)"
         f" - ({_LA} + {_RA}) * ({_LA} + {_RA}) / ({_LB} + {_RB} + {RIDGE}::DOUBLE)")
_STEP = f"-0.3::DOUBLE * (ta / {_G}) / (tb / {_G} + {RIDGE}::DOUBLE)"


def _round(t):
    """Tables of one boosted stump: weights from the odds so far, its cut, its nodes and the odds after it."""
    odds = "ent_odds" if t == 0 else f"odds{t - 1}"
    weighed = f"""(SELECT tree, entry_ordinal, CAST(round_even((p - label) * {_G}, 0) AS BIGINT) AS wa,
   CAST(round_even(greatest(p * (1 - p), 1e-16::DOUBLE) * {_G}, 0) AS BIGINT) AS wb, 1 AS n
  FROM (SELECT entry_ordinal, label, hashed, 1 / (1 + exp(-odds)) AS p FROM {odds}), own
  WHERE tree = {t} AND (hashed * ha + hb) % {PRIME} < 0.8::DOUBLE * {PRIME})"""
    grown = _grown(f"b{t}", weighed, 1, _GAIN, f"gain > 1e-6 AND lb / {_G} >= 2 AND rb / {_G} >= 2", _all, "gain >= 0.01")
    return f"""{grown},
 bn{t} AS ({_nodes(f"b{t}", 1, _STEP, f" / {_G}")}),
 odds{t} AS (SELECT e.* EXCLUDE (odds), odds + coalesce(leaf.value, root.value) AS odds FROM {odds} e
  JOIN bn{t} root ON root.node = 1 LEFT JOIN bn{t} leaf ON leaf.node = 2 + CAST(vs[root.f + 1] > root.threshold AS BIGINT))"""


_BOOSTED = f"""{_tables(3)}, ent_odds AS (SELECT *, 0.0::DOUBLE AS odds FROM ent), {", ".join(map(_round, range(3)))}"""
ORACLE["boosted_stumps"] = f"""WITH {_BOOSTED} SELECT tree, node, feature, threshold, round_even(n0, 6) AS n0, round_even(n1, 6) AS n1,
 round_even(value, 6) AS value FROM (SELECT * FROM bn0 UNION ALL SELECT * FROM bn1 UNION ALL SELECT * FROM bn2)"""
ORACLE["boosted_stump_scores"] = f"WITH {_BOOSTED} SELECT entry_ordinal, label, round_even(1 / (1 + exp(-odds)), 6) AS score FROM odds2"


def oracles():
    return {name: with_ctes(sql) for name, sql in ORACLE.items()}
