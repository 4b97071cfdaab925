"""Independent SQL for the named queries that SQL can express, over the same tables."""

from __future__ import annotations

# Fixed values, typed here anew so that a wrong constant of the library does not pass.
PRIME = 2147483647
RISK_BANDS = ("🔴 HIGH RISK", "🟡 MODERATE RISK", "🟢 POSITIVE", "✅ NEGATIVE")
RISK_THRESHOLDS = {"age": 50.0, "bmi": 30.0, "heart_rate": 85.0, "blood_pressure": 140.0, "cholesterol": 240.0}
THRESHOLD_LEVELS = [*(0.01 + i * ((0.99 - 0.01) / 198) for i in range(198)), 0.99]
LATENT_NOISE = {
    "Diabetes": (0, 2), "Hypertension": (0, 2), "Heart_Disease": (0, 2), "Asthma": (0, 3), "Arthritis": (0, 2),
    "Healthy": (-3, 1),
}
LATENT_WEIGHTS = {
    "Diabetes": {"bmi": (0.05, 25), "age": (0.03, 40)},
    "Hypertension": {"blood_pressure": (0.08, 120), "age": (0.04, 50)},
    "Heart_Disease": {"cholesterol": (0.06, 200), "age": (0.05, 55), "bmi": (0.03, 25)},
    "Asthma": {"age": (-0.02, 0)},
    "Arthritis": {"age": (0.08, 45)},
    "Healthy": {},
}
OUTCOME_WEIGHTS = {"age": (0.04, 50), "bmi": (0.1, 25)}
MULTICLASS_MEASURES = {
    "bmi": (27, 5, 15, 50), "heart_rate": (75, 12, 50, 120), "blood_pressure": (120, 15, 80, 180),
    "cholesterol": (200, 40, 120, 350),
}
TIERED_MEASURES = {
    "age": (45, 15, 18, 80), "bmi": (25, 5, 15, 45), "heart_rate": (72, 12, 50, 120),
    "blood_pressure": (120, 20, 90, 180), "cholesterol": (200, 40, 150, 350),
}
TIER_CLASSES = {
    3: ["Heart_Disease", "Hypertension", "Diabetes"],
    2: ["Diabetes", "Hypertension", "Arthritis"],
    1: ["Asthma", "Arthritis"],
    0: ["Healthy"],
}


def num(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def r6(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6 + {num(0.5)}) / 1e6 AS {name}"


# --- shared table expressions ----------------------------------------------------------------

GAPPY = """g AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity,
  CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS discount,
  l_extendedprice AS price,
  CASE WHEN l_suppkey % 13 <> 0 THEN l_returnflag END AS returnflag,
  l_linestatus AS linestatus FROM lineitem)"""

MEDIANS = "md AS (SELECT median(quantity) q, median(discount) d, median(price) p FROM g)"
FILLED = f"""{GAPPY}, {MEDIANS},
 modes AS (SELECT (SELECT returnflag FROM g WHERE returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) rf,
  (SELECT linestatus FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ls),
 f AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, md.q) quantity, coalesce(discount, md.d) discount,
  coalesce(price, md.p) price, coalesce(returnflag, rf) returnflag, coalesce(linestatus, ls) linestatus,
  (CASE WHEN quantity IS NULL THEN 1 ELSE 0 END + CASE WHEN discount IS NULL THEN 1 ELSE 0 END
   + CASE WHEN returnflag IS NULL THEN 1 ELSE 0 END + CASE WHEN linestatus IS NULL THEN 1 ELSE 0 END) gaps
  FROM g, md, modes),
 st AS (SELECT avg(quantity) qm, stddev_pop(quantity) qs, avg(discount) dm, stddev_pop(discount) ds,
  avg(price) pm, stddev_pop(price) ps FROM f)"""
SCALED = f"""{FILLED}, s AS (SELECT f.*, (quantity - qm) / qs AS zq, (discount - dm) / ds AS zd,
  (price - pm) / ps AS zp FROM f, st)"""
BIN = "CASE WHEN {x} < 0 THEN 0 WHEN {x} < 30 THEN 1 WHEN {x} < 45 THEN 2 WHEN {x} < 60 THEN 3 WHEN {x} < 120 THEN 4 ELSE 5 END"

LABELLED = "labels JOIN documents USING (doc_id)"
JUDGED = """j AS (SELECT o_orderkey, o_orderstatus AS y, CASE WHEN o_totalprice > 300000 THEN 'F'
  WHEN o_orderkey % 3 = 0 THEN 'O' ELSE 'P' END AS pred FROM orders)"""
STATS = f"""{JUDGED}, names AS (SELECT y AS label FROM j UNION SELECT pred FROM j),
 s AS (SELECT label, (SELECT count(*) FROM j WHERE y = label AND pred = label) tp,
  (SELECT count(*) FROM j WHERE y = label) support, (SELECT count(*) FROM j WHERE pred = label) predicted FROM names),
 pr AS (SELECT label, support, tp, CASE WHEN predicted = 0 THEN 0e0 ELSE tp / predicted END AS p,
  CASE WHEN support = 0 THEN 0e0 ELSE tp / support END AS r FROM s),
 sc AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""

BINARY = """b AS (SELECT 0 AS cls, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pos,
  l_discount * 3e0 + l_quantity / 100e0 AS score FROM lineitem)"""
CLASS_ROWS = f"""raw AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  l_quantity / 50e0 AS a, l_discount * 10e0 + {num(0.1)} AS b, l_tax * 12e0 + {num(0.1)} AS c FROM lineitem),
 cr AS (SELECT y, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM raw)"""
CLASS_LONG = """b AS (SELECT 0 AS cls, CASE WHEN y = 0 THEN 1 ELSE 0 END AS pos, p0 AS score, y FROM cr
 UNION ALL SELECT 1, CASE WHEN y = 1 THEN 1 ELSE 0 END, p1, y FROM cr
 UNION ALL SELECT 2, CASE WHEN y = 2 THEN 1 ELSE 0 END, p2, y FROM cr)"""
MULTI = """m AS (SELECT doc_id, quality, toxic, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pq,
  CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS pt, n_chars / 20000e0 AS sq, n_chars % 100 / 100e0 AS st
  FROM labels JOIN documents USING (doc_id))"""
MULTI_LONG = "b AS (SELECT 0 AS cls, quality AS pos, sq AS score FROM m UNION ALL SELECT 1, toxic, st FROM m)"
# rank-sum with average ranks for ties
AUC = """rk AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY score)
   + (count(*) OVER (PARTITION BY cls, score) - 1) / 2e0 AS r FROM b),
 auc AS (SELECT cls, sum(CASE WHEN pos = 1 THEN r END) AS rs, sum(pos)::DOUBLE AS p, sum(1 - pos)::DOUBLE AS n FROM rk GROUP BY cls),
 av AS (SELECT cls, CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2) / (p * n) END AS auc FROM auc)"""
AP = """gr AS (SELECT cls, score, sum(pos)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM b GROUP BY cls, score),
 cu AS (SELECT cls, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY cls) AS p FROM gr
  WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 ap AS (SELECT cls, sum(pos * tp / seen) / max(p) AS ap FROM cu GROUP BY cls)"""

NAMES = ("Filled_Late", "On_Time", "Partly_Sent")
CLASS_ORDERS = """raw AS (SELECT o_orderkey, o_totalprice / 500000e0 AS a, (o_custkey % 97 + 1) / 97e0 AS b,
  (o_orderkey % 101 + 1) / 101e0 AS c FROM orders),
 co AS (SELECT o_orderkey, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM raw)"""
RANKED = f"""{CLASS_ORDERS}, lg AS (
  SELECT o_orderkey, 0 AS i, '{NAMES[0]}' AS name, p0 AS p FROM co
  UNION ALL SELECT o_orderkey, 1, '{NAMES[1]}', p1 FROM co UNION ALL SELECT o_orderkey, 2, '{NAMES[2]}', p2 FROM co),
 rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC, i) AS k FROM lg),
 wd AS (SELECT o_orderkey, max(CASE WHEN k = 1 THEN name END) n1, max(CASE WHEN k = 1 THEN p END) v1,
  max(CASE WHEN k = 2 THEN name END) n2, max(CASE WHEN k = 2 THEN p END) v2,
  max(CASE WHEN k = 3 THEN name END) n3, max(CASE WHEN k = 3 THEN p END) v3 FROM rk GROUP BY o_orderkey)"""
ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
BINARY_ORDERS = "bo AS (SELECT o_orderkey, o_totalprice / 500001e0 AS p FROM orders)"

MEASURES = """ms AS (SELECT l_orderkey, l_linenumber, l_quantity * 3e0 - 10e0 AS age, l_discount * 300e0 + 15e0 AS bmi,
  l_tax * 500e0 + 60e0 AS heart_rate, l_extendedprice / 1000e0 + 80e0 AS blood_pressure,
  l_partkey % 250 + 100e0 AS cholesterol FROM lineitem)"""

ATTRIBUTED = f"""l AS (SELECT l_orderkey AS row_id, sum(l_quantity) AS lq, max(l_discount) AS ld, max(l_extendedprice) AS lp FROM lineitem GROUP BY 1),
 mean AS (SELECT avg(lq) q, avg(ld) d, avg(lp) p FROM l),
 a AS (SELECT row_id, {num(0.8)} * (lq - q) AS vq, {num(-25.0)} * (ld - d) AS vd, {num(0.0001)} * (lp - p) AS vp FROM l, mean)"""
ATTRIBUTED_LONG = f"""{ATTRIBUTED}, al AS (SELECT row_id, 'quantity' AS feature, vq AS value, abs(vq) AS abs_value FROM a
 UNION ALL SELECT row_id, 'discount', vd, abs(vd) FROM a UNION ALL SELECT row_id, 'price', vp, abs(vp) FROM a)"""


def unit(key: str, seed: int) -> str:
    """The integer hash of ``functions.hashing`` as nested SQL."""
    a = f"((({key} % {PRIME}) * 48271 + ({key} // {PRIME}) * 16807 + {seed * 7919 + 12345}) % {PRIME})"
    return (
        f"(SELECT ((xor(b, b >> 13) * 39373) % {PRIME} + {num(0.5)}) / {num(PRIME + 1)} FROM "
        f"(SELECT (xor(a, a >> 15) * 69621 + {seed}) % {PRIME} AS b FROM (SELECT {a}::BIGINT AS a)))"
    )


def uniform_int(key: str, low: int, high: int, seed: int) -> str:
    return f"({low} + floor({unit(key, seed)} * {high - low}))::BIGINT"


def normal(key: str, mean: float, std: float, seed: int) -> str:
    u, v = unit(key, 2 * seed + 1), unit(key, 2 * seed + 2)
    return f"({num(mean)} + {num(std)} * (sqrt(-2e0 * ln({u})) * cos({num(2 * 3.141592653589793)} * {v})))"


def choice(key: str, values: list, seed: int) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"[{items}][floor({unit(key, seed)} * {len(values)})::INT + 1]"


def clip(x: str, low: float, high: float) -> str:
    return f"greatest({num(low)}, least({num(high)}, {x}))"


def measures(key: str, spec: dict, seed: int) -> str:
    return ", ".join(
        f"{clip(normal(key, mean, std, seed + i), low, high)} AS {c}"
        for i, (c, (mean, std, low, high)) in enumerate(spec.items())
    )


def weighted(spec: dict, noise: str) -> str:
    return " + ".join([noise, *(f"{num(w)} * ({c} - {num(m)})" for c, (w, m) in spec.items())])


def first_maximum(scores: dict[str, str]) -> str:
    names = list(scores)
    out = f"'{names[-1]}'"
    for n in reversed(names[:-1]):
        out = f"CASE WHEN {scores[n]} = greatest({', '.join(scores.values())}) THEN '{n}' ELSE {out} END"
    return out


RULE = " + ".join(f"CASE WHEN {c} > {num(t)} THEN 1 ELSE 0 END" for c, t in RISK_THRESHOLDS.items())


def multiclass_rows(key: str, source: str, seed: int = 42) -> str:
    noise = ", ".join(
        f"{normal(key, m, s, seed + 10 + i)} AS e_{c}" for i, (c, (m, s)) in enumerate(LATENT_NOISE.items())
    )
    scores = ", ".join(f"{weighted(LATENT_WEIGHTS[c], f'e_{c}')} AS s_{c}" for c in LATENT_NOISE)
    name = first_maximum({c: f"s_{c}" for c in LATENT_NOISE})
    return f"""m0 AS (SELECT {key}, {uniform_int(key, 18, 85, seed + 1)} AS age, {choice(key, ['M', 'F'], seed + 2)} AS gender,
  {measures(key, MULTICLASS_MEASURES, seed + 3)}, {noise} FROM {source}),
 m1 AS (SELECT *, {scores} FROM m0), mc AS (SELECT *, {name} AS prognosis FROM m1)"""


def profile(column: str, numeric: bool) -> str:
    flag = f"count(*) > count({column})" if numeric else "true"
    return f"SELECT '{column}' AS \"column\", count(*) - count({column}) AS n_null, count(*) AS n_rows, {flag} AS nullable FROM g"


def check(column: str, low: float, high: float) -> str:
    return (
        f"SELECT '{column}' AS \"column\", 'between {low} and {high}' AS \"check\", "
        f"count(*) FILTER (WHERE {column} < {num(low)} OR {column} > {num(high)}) AS n_failed FROM lineitem"
    )


def fold_rows(i: int) -> str:
    parts = []
    for c in ("quantity", "discount", "price"):
        parts.append(
            f"SELECT {i} AS fold, '{c}' AS \"column\", median({c}) AS median, avg(x) AS mean, stddev_pop(x) AS std FROM "
            f"(SELECT {c}, coalesce({c}, (SELECT median({c}) FROM g WHERE l_orderkey % 3 <> {i})) AS x "
            f"FROM g WHERE l_orderkey % 3 <> {i})"
        )
    return " UNION ALL ".join(parts)


CLASS_SCORE = "CASE a WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
HIGH, MODERATE, POSITIVE, NEGATIVE = RISK_BANDS
LEVEL_LIST = "[" + ", ".join(num(x) for x in THRESHOLD_LEVELS) + "]"

ORACLE: dict[str, str] = {
    "null_profile": f"WITH {GAPPY} " + " UNION ALL ".join(
        profile(c, n) for c, n in (
            ("l_orderkey", True), ("l_linenumber", True), ("quantity", True), ("discount", True),
            ("price", True), ("returnflag", False), ("linestatus", False),
        )
    ),
    "missing_count": f"""WITH {GAPPY}, c AS (SELECT (CASE WHEN quantity IS NULL THEN 1e0 ELSE 0e0 END
  + CASE WHEN discount IS NULL THEN 1e0 ELSE 0e0 END + CASE WHEN returnflag IS NULL THEN 1e0 ELSE 0e0 END) AS missing_count FROM g)
 SELECT missing_count, count(*) AS n_rows FROM c GROUP BY 1""",
    "range_violations": " UNION ALL ".join(
        [check("l_quantity", 5, 45), check("l_discount", 0.01, 0.09), check("l_tax", 0, 0.07)]
    ),
    "violating_rows": f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
 WHERE l_quantity NOT BETWEEN 5 AND 45 OR l_discount < {num(0.01)} OR l_discount > {num(0.09)} OR l_tax > {num(0.07)}""",
    "contract_failures": """SELECT 'o_clerk' AS "column", 'column present' AS "check", 1::BIGINT AS n_failed
 UNION ALL SELECT 'o_custkey', 'type float', 1 UNION ALL SELECT 'o_totalprice', 'between 1000 and 400000',
 count(*) FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000 HAVING count(*) > 0""",
    "leakage_drop": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "impute_median": f"""WITH {FILLED} SELECT l_orderkey, l_linenumber, {r6('quantity', 'quantity')},
 {r6('discount', 'discount')}, {r6('price', 'price')} FROM f""",
    "impute_mode": f"WITH {FILLED} SELECT l_orderkey, l_linenumber, returnflag, linestatus FROM f",
    "fitted_parameters": f"""WITH {FILLED}, o AS (
 SELECT 'quantity' AS "column", md.q AS median, qm AS mean, qs AS std, NULL AS mode, NULL AS n_values FROM md, st
 UNION ALL SELECT 'discount', md.d, dm, ds, NULL, NULL FROM md, st UNION ALL SELECT 'price', md.p, pm, ps, NULL, NULL FROM md, st
 UNION ALL SELECT 'returnflag', NULL, NULL, NULL, (SELECT rf FROM modes), (SELECT count(DISTINCT returnflag) FROM f)
 UNION ALL SELECT 'linestatus', NULL, NULL, NULL, (SELECT ls FROM modes), (SELECT count(DISTINCT linestatus) FROM f))
 SELECT "column", {r6('median', 'median')}, {r6('mean', 'mean')}, {r6('std', 'std')}, mode, n_values::INT AS n_values FROM o""",
    "scale_standard": f"""WITH {SCALED} SELECT l_orderkey, l_linenumber, {r6('zq', 'quantity')},
 {r6('zd', 'discount')}, {r6('zp', 'price')} FROM s""",
    "scale_off": f"""WITH {FILLED} SELECT l_orderkey, l_linenumber, {r6('quantity', 'quantity')}, {r6('price', 'price')} FROM f""",
    "bin_edges": f"""WITH {MEASURES} SELECT {BIN.format(x='age')}::INT AS bin, count(*) AS n_rows, min(age) AS low, max(age) AS high
 FROM ms GROUP BY 1""",
    "one_hot": f"""WITH {GAPPY}, md AS (SELECT returnflag AS rf FROM g WHERE returnflag <> 'R' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
 SELECT coalesce(returnflag, 'gap') AS flag, count(*) AS n_rows,
 sum(CASE WHEN coalesce(returnflag, rf) = 'A' THEN 1e0 ELSE 0e0 END) AS "returnflag_A",
 sum(CASE WHEN coalesce(returnflag, rf) = 'N' THEN 1e0 ELSE 0e0 END) AS "returnflag_N" FROM g, md GROUP BY 1""",
    "one_hot_entries": f"""WITH {GAPPY} SELECT 'returnflag' AS "column", returnflag AS value, count(*) AS n_rows FROM g
 WHERE returnflag <> 'R' GROUP BY 2
 UNION ALL SELECT 'linestatus', linestatus, count(*) FROM g
 WHERE linestatus IN (SELECT linestatus FROM g WHERE coalesce(returnflag, '') <> 'R') GROUP BY 2""",
    "interaction": f"WITH {SCALED} SELECT l_orderkey, l_linenumber, {r6('zq * zd', 'quantity_x_discount')} FROM s",
    "feature_matrix": f"""WITH {SCALED} SELECT l_orderkey, l_linenumber, gaps::DOUBLE AS missing_count, {r6('zq', 'quantity')},
 {r6('zd', 'discount')}, ({BIN.format(x='quantity')})::DOUBLE AS quantity_bin,
 (returnflag = 'A')::INT::DOUBLE AS "returnflag_A", (returnflag = 'N')::INT::DOUBLE AS "returnflag_N",
 (returnflag = 'R')::INT::DOUBLE AS "returnflag_R", (linestatus = 'F')::INT::DOUBLE AS "linestatus_F",
 (linestatus = 'O')::INT::DOUBLE AS "linestatus_O", {r6('zq * zd', 'quantity_x_discount')} FROM s""",
    "feature_vector": f"""WITH {SCALED}, w AS (SELECT gaps::DOUBLE AS missing_count, zq AS quantity, zd AS discount,
 ({BIN.format(x='quantity')})::DOUBLE AS quantity_bin, (returnflag = 'A')::INT::DOUBLE AS "returnflag_A",
 (returnflag = 'N')::INT::DOUBLE AS "returnflag_N", (returnflag = 'R')::INT::DOUBLE AS "returnflag_R",
 (linestatus = 'F')::INT::DOUBLE AS "linestatus_F", (linestatus = 'O')::INT::DOUBLE AS "linestatus_O",
 zq * zd AS quantity_x_discount FROM s) """ + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg({q})', 'mean')}, {r6(f'max({q})', 'high')} FROM w"
        for c, q in (
            (c, f'"{c}"') for c in (
                "missing_count", "quantity", "discount", "quantity_bin", "returnflag_A", "returnflag_N",
                "returnflag_R", "linestatus_F", "linestatus_O", "quantity_x_discount",
            )
        )
    ),
    "fold_parameters": f"WITH {GAPPY}, o AS (" + " UNION ALL ".join(fold_rows(i) for i in range(3))
    + f""") SELECT fold, "column", {r6('median', 'median')}, {r6('mean', 'mean')}, {r6('std', 'std')} FROM o""",
    "label_encode": """SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label_idx FROM customer""",
    "label_decode": """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label_idx,
 c_mktsegment AS segment FROM customer""",
    "task_type": " UNION ALL ".join(
        f"SELECT '{c}' AS target, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'multiclass' END AS task FROM {t}"
        for c, t in (("quality", "labels"), ("toxic", "labels"), ("label", "embeddings"))
    ) + " UNION ALL SELECT 'absent', 'multiclass' UNION ALL SELECT 'both', 'multilabel'",
    "class_weights": f"""WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, l_returnflag, {r6('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 'weight')}
 FROM lineitem JOIN c USING (l_returnflag)""",
    "class_weight_table": f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
 SELECT quality, n, {r6('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 'weight')} FROM c""",
    "pos_weight": f"""SELECT {r6("CASE WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 1e0 ELSE count(*) FILTER (WHERE quality <> 1)::DOUBLE / count(*) FILTER (WHERE quality = 1) END", 'pos_weight')} FROM labels""",
    "multilabel_weights": f"""WITH t AS (SELECT count(*)::DOUBLE n, sum(quality) q, sum(toxic) x FROM labels),
 w AS (SELECT labels.*, CASE WHEN quality + toxic = 0 THEN 1e0
  ELSE (quality * (n / (2 * q + 1)) + toxic * (n / (2 * x + 1))) / (quality + toxic) END AS raw FROM labels, t)
 SELECT doc_id, quality, toxic, {r6('raw * ((SELECT n FROM t) / (SELECT sum(raw) FROM w))', 'weight')} FROM w""",
    "confusion_counts": f"WITH {JUDGED} SELECT y, pred, count(*) AS n FROM j GROUP BY 1, 2",
    "confusion_matrix": f"""WITH {JUDGED} SELECT y, count(*) FILTER (WHERE pred = 'F') AS "F", count(*) FILTER (WHERE pred = 'O') AS "O",
 count(*) FILTER (WHERE pred = 'P') AS "P" FROM j GROUP BY y""",
    "accuracy": f"WITH {JUDGED} SELECT {r6('avg(CASE WHEN y = pred THEN 1e0 ELSE 0e0 END)', 'accuracy')} FROM j",
    "macro_scores": f"""WITH {STATS} SELECT {r6('avg(p)', 'macro_precision')}, {r6('avg(r)', 'macro_recall')},
 {r6('avg(f)', 'macro_f1')} FROM sc""",
    "weighted_f1": f"WITH {STATS} SELECT {r6('sum(f * support) / sum(support)', 'weighted_f1')} FROM sc",
    "per_class_scores": f"""WITH {STATS} SELECT label AS class, {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f', 'f1')},
 support::BIGINT AS support FROM sc UNION ALL SELECT 'never', 0e0, 0e0, 0e0, 0""",
    "class_report": f"""WITH {STATS}, o AS (SELECT label, p, r, f, support FROM sc
 UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM sc
 UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM sc
 UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
  sum(f * support) / sum(support), sum(support) FROM sc)
 SELECT label, {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f', 'f1')}, support::BIGINT AS support FROM o""",
    "multilabel_scores": f"""WITH {MULTI}, t AS (SELECT sum(quality * pq) q, sum(quality + pq) qn, sum(toxic * pt) x, sum(toxic + pt) xn,
  avg(CASE WHEN quality + pq + toxic + pt = 0 THEN 0e0 ELSE 2e0 * (quality * pq + toxic * pt) / (quality + pq + toxic + pt) END) AS sf,
  avg(CASE WHEN quality = pq AND toxic = pt THEN 1e0 ELSE 0e0 END) AS ac FROM m)
 SELECT {r6('(2e0 * q / qn + 2e0 * x / xn) / 2', 'macro_f1')}, {r6('2e0 * (q + x) / (qn + xn)', 'micro_f1')},
 {r6('sf', 'samples_f1')}, {r6('ac', 'accuracy')} FROM t""",
    "multilabel_decision": f"""WITH {MULTI} SELECT doc_id, (sq >= {num(0.3)})::INT AS quality, (st >= {num(0.3)})::INT AS toxic FROM m""",
    "roc_auc": f"WITH {BINARY}, {AUC} SELECT {r6('auc', 'roc_auc')} FROM av",
    "roc_auc_ovr": f"WITH {CLASS_ROWS}, {CLASS_LONG}, {AUC} SELECT {r6('avg(auc)', 'roc_auc_ovr')} FROM av",
    "roc_auc_ovo": f"""WITH {CLASS_ROWS}, pairs AS (SELECT x.a, y.b FROM (SELECT unnest([0, 1, 2]) AS a) x, (SELECT unnest([0, 1, 2]) AS b) y WHERE a <> b),
 b AS (SELECT a * 10 + b AS cls, CASE WHEN y = a THEN 1 ELSE 0 END AS pos, {CLASS_SCORE} AS score FROM cr JOIN pairs ON y = a OR y = b),
 {AUC} SELECT {r6('avg(auc)', 'roc_auc_ovo')} FROM av""",
    "roc_auc_per_label": f"WITH {MULTI}, {MULTI_LONG}, {AUC} SELECT cls, {r6('auc', 'auc')} FROM av",
    "roc_auc_multilabel": f"WITH {MULTI}, {MULTI_LONG}, {AUC} SELECT {r6('avg(auc)', 'roc_auc_macro')} FROM av",
    "average_precision": f"WITH {BINARY}, {AP} SELECT {r6('ap', 'pr_auc')} FROM ap",
    "average_precision_macro": f"WITH {CLASS_ROWS}, {CLASS_LONG}, {AP} SELECT {r6('avg(ap)', 'pr_auc')} FROM ap",
    "best_f1_threshold": f"""WITH {BINARY}, q AS (SELECT DISTINCT unnest(quantile_cont(score, {LEVEL_LIST})) AS t FROM b),
 gr AS (SELECT score, sum(pos)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM b GROUP BY score),
 c AS (SELECT t, sum(pos) AS tp, sum(n) AS called, (SELECT sum(pos) FROM gr) AS p FROM q JOIN gr ON score >= t GROUP BY t),
 pr AS (SELECT t, tp / called AS pc, tp / p AS rc FROM c),
 f AS (SELECT t, CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0e0 END AS f1 FROM pr)
 SELECT {r6('t', 'threshold')}, {r6('f1', 'f1')} FROM (SELECT * FROM f ORDER BY f1 DESC, t LIMIT 1)""",
    "score_quantiles": "WITH o AS (" + " UNION ALL ".join(
        f"SELECT {num(q)} AS level, quantile_cont(l_extendedprice, {num(q)}) AS v FROM lineitem" for q in (0.01, 0.25, 0.5, 0.77, 0.99)
    ) + f") SELECT level, {r6('v', 'value')} FROM o",
    "topk_classes": f"""WITH {RANKED} SELECT o_orderkey, n1 AS prediction, n1 AS top1_disease, {r6('v1', 'top1_probability')},
 n2 AS top2_disease, {r6('v2', 'top2_probability')}, n3 AS top3_disease, {r6('v3', 'top3_probability')} FROM wd""",
    "ranked_text": f"""WITH {RANKED} SELECT o_orderkey, n1 AS predicted_disease, n1 AS rank1_disease,
 format('{{:.1f}}%', v1 * 100) AS rank1_probability, n2 AS rank2_disease, format('{{:.1f}}%', v2 * 100) AS rank2_probability FROM wd""",
    "multiclass_table": f"""WITH {CLASS_ORDERS} SELECT o_orderkey, {ARGMAX}::INT AS prediction, {r6('p0', 'class_0_proba')},
 {r6('p1', 'class_1_proba')}, {r6('p2', 'class_2_proba')} FROM co""",
    "probability_table": f"""WITH {CLASS_ORDERS} SELECT o_orderkey, {r6('p0', f'"{NAMES[0]}"')}, {r6('p1', f'"{NAMES[1]}"')},
 {r6('p2', f'"{NAMES[2]}"')} FROM co""",
    "argmax_class": f"""WITH {CLASS_ORDERS} SELECT o_orderkey, ['{NAMES[0]}', '{NAMES[1]}', '{NAMES[2]}'][{ARGMAX} + 1] AS prediction FROM co""",
    "record_table": f"""WITH {RANKED} SELECT o_orderkey + 1 AS "Patient", n1 AS "Predicted_Disease", format('{{:.1f}}%', v1 * 100) AS "Confidence",
 n1 || ' (' || format('{{:.1f}}%', v1 * 100) || '), ' || n2 || ' (' || format('{{:.1f}}%', v2 * 100) || '), ' || n3 || ' ('
 || format('{{:.1f}}%', v3 * 100) || ')' AS "Top_3_Diseases" FROM wd""",
    "ranked_records": f"""WITH {RANKED} SELECT o_orderkey, k::INT AS position, name AS disease, {r6('p', 'probability')},
 k = 1 AS is_predicted FROM rk""",
    "named_probability_map": f"WITH {CLASS_ORDERS} SELECT o_orderkey, {r6('p1', 'on_time')} FROM co",
    "class_captions": f"""WITH {CLASS_ORDERS} SELECT o_orderkey, 'Disease Class ' || {ARGMAX} AS disease,
 {r6('greatest(p0, p1, p2)', 'confidence')} FROM co""",
    "binary_captions": f"""WITH {BINARY_ORDERS} SELECT o_orderkey, CASE WHEN p > {num(0.5)} THEN 'Disease Detected' ELSE 'Healthy' END AS disease,
 {r6('greatest(p, 1e0 - p)', 'confidence')} FROM bo""",
    "binary_table": f"""WITH {BINARY_ORDERS} SELECT o_orderkey, (p >= {num(0.35)})::INT AS prediction,
 CASE WHEN p < {num(0.35)} THEN '{NEGATIVE}' WHEN p >= {num(0.8)} THEN '{HIGH}' WHEN p >= {num(0.6)} THEN '{MODERATE}' ELSE '{POSITIVE}' END AS risk_level,
 {r6('p', 'probability')} FROM bo""",
    "pred_summary": f"""WITH {BINARY_ORDERS} SELECT count(*) AS total, count(*) FILTER (WHERE p >= {num(0.35)}) AS positive,
 count(*) FILTER (WHERE p < {num(0.35)}) AS negative FROM bo""",
    "value_share": f"""WITH {JUDGED} SELECT pred AS value, count(*) AS n_rows, {r6('count(*)::DOUBLE / (SELECT count(*) FROM j)', 'share')}
 FROM j GROUP BY pred ORDER BY n_rows DESC, value LIMIT 10""",
    "percent_text": f"WITH {BINARY_ORDERS} SELECT o_orderkey, format('{{:.1f}}%', p * 100) AS text FROM bo",
    "display_names": "SELECT p_partkey, replace(p_name || ' ' || p_type, '_', ' ') AS name FROM part",
    "rule_scores": f"""WITH {MEASURES}, s AS (SELECT {RULE} AS score FROM ms)
 SELECT score::INT AS score, least(3, score)::INT AS tier, count(*) AS n_rows FROM s GROUP BY 1, 2""",
    "clipped_values": f"""WITH {MEASURES} SELECT l_orderkey, l_linenumber, {r6(clip('age', 0, 100), 'age')}, {r6(clip('bmi', 18, 40), 'bmi')} FROM ms""",
    "logistic_outcome": f"""WITH {MEASURES}, p AS (SELECT l_orderkey, l_linenumber, 1e0 / (1e0 + exp(-({weighted(OUTCOME_WEIGHTS, '0e0')}))) AS p FROM ms)
 SELECT l_orderkey, l_linenumber, {r6('p', 'p')}, (p > {num(0.5)})::INT AS outcome FROM p""",
    "latent_class": f"""WITH {MEASURES}, s AS (SELECT {', '.join(f"{weighted(w, '0e0')} AS s_{c}" for c, w in LATENT_WEIGHTS.items())} FROM ms),
 c AS (SELECT {first_maximum({c: f's_{c}' for c in LATENT_WEIGHTS})} AS prognosis FROM s)
 SELECT prognosis, count(*) AS n_rows FROM c GROUP BY 1""",
    "sex_codes": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE 1e0 END AS from_text,
 (o_custkey % 2)::DOUBLE AS from_number FROM orders""",
    "numeric_coercion": """SELECT 'price' AS "column", 0::BIGINT AS n_rejected UNION ALL
 SELECT 'priority', count(*) FILTER (WHERE try_cast(o_orderpriority AS DOUBLE) IS NULL) FROM orders""",
    "generated_binary": f"""WITH m AS (SELECT c_custkey, {uniform_int('c_custkey', 20, 80, 43)} AS age, {choice('c_custkey', ['M', 'F'], 44)} AS gender,
 {normal('c_custkey', 28, 4, 45)} AS bmi, {normal('c_custkey', 75, 8, 46)} AS heart_rate,
 {choice('c_custkey', ['none', 'short', 'long'], 47)} AS discharge_notes, {normal('c_custkey', 1000, 200, 48)} AS bill_amount,
 {normal('c_custkey', 0, 1, 49)} AS noise FROM customer)
 SELECT c_custkey, age, gender, {r6('bmi', 'bmi')}, {r6('heart_rate', 'heart_rate')}, discharge_notes, {r6('bill_amount', 'bill_amount')},
 (1e0 / (1e0 + exp(-({weighted(OUTCOME_WEIGHTS, 'noise')}))) > {num(0.5)})::INT AS outcome FROM m""",
    "generated_multiclass": f"""WITH {multiclass_rows('c_custkey', 'customer')} SELECT c_custkey, age, gender,
 {', '.join(r6(c, c) for c in MULTICLASS_MEASURES)}, prognosis FROM mc""",
    "generated_tiers": f"""WITH m AS (SELECT c_custkey, {choice('c_custkey', [0, 1], 43)} AS gender,
 {measures('c_custkey', TIERED_MEASURES, 44)}, {unit('c_custkey', 49)} AS u FROM customer),
 t AS (SELECT *, least(3, {RULE}) AS tier FROM m)
 SELECT c_custkey, gender, {', '.join(r6(c, c) for c in TIERED_MEASURES)}, CASE tier {' '.join(
        f"WHEN {k} THEN {v}[floor(u * {len(v)})::INT + 1]" for k, v in TIER_CLASSES.items())} END AS prognosis FROM t""",
    "generated_labels": f"WITH {multiclass_rows('o_orderkey', 'orders')} SELECT prognosis, count(*) AS n_rows FROM mc GROUP BY 1",
    "linear_attribution": f"WITH {ATTRIBUTED_LONG} SELECT row_id, feature, {r6('value', 'value')}, {r6('abs_value', 'abs_value')} FROM al",
    "topk_features": f"""WITH {ATTRIBUTED_LONG}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs_value DESC, feature) AS rank FROM al)
 SELECT row_id, feature, {r6('value', 'value')}, {r6('abs_value', 'abs_value')}, rank::INT AS rank FROM k WHERE rank <= 2""",
    "topk_features_long": f"""WITH {ATTRIBUTED_LONG}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs_value DESC, feature) AS rank FROM al)
 SELECT row_id, feature, {r6('value', 'value')}, {r6('abs_value', 'abs_value')}, rank::INT AS rank FROM k WHERE rank <= 1""",
    "global_importance": f"WITH {ATTRIBUTED_LONG} SELECT feature, {r6('avg(abs_value)', 'mean_abs_shap')} FROM al GROUP BY feature",
    "attribution_wide": f"""WITH {ATTRIBUTED_LONG}, u AS (SELECT * FROM al) SELECT row_id AS index,
 {r6("sum(CASE WHEN feature = 'quantity' THEN value END)", 'quantity')}, {r6("sum(CASE WHEN feature = 'discount' THEN value END)", 'discount')},
 {r6("sum(CASE WHEN feature = 'price' THEN value END)", 'price')} FROM u GROUP BY row_id""",
    "attribution_projection": f"WITH {ATTRIBUTED} SELECT row_id AS index, {r6('vq', 'quantity')}, {r6('vd', 'discount')}, {r6('vp', 'price')} FROM a",
    "row_explanation": f"""WITH {ATTRIBUTED_LONG}, u AS (SELECT * FROM al) SELECT feature, {r6('value', 'shap_value')} FROM u
 WHERE row_id = (SELECT min(row_id) FROM u) ORDER BY abs_value DESC, feature LIMIT 20""",
    "sample_rows": f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {unit('doc_id', 42)}, doc_id LIMIT 100",
    "preview": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10",
    "row_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17",
    "row_numbers": "SELECT 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS n_rows, count(*) AS n_distinct FROM lineitem",
    "group_folds": "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, 0::BIGINT AS n_split FROM orders",
    "csv_round_trip": f"""WITH {GAPPY} SELECT count(*) AS n_rows, sum(l_orderkey)::BIGINT AS keys, count(quantity) AS n_quantity,
 {r6('sum(quantity)', 'quantity')}, count(discount) AS n_discount, count(returnflag) AS n_returnflag, min(linestatus) AS first_status FROM g""",
    "report_round_trip": f"""WITH {JUDGED}, n AS (SELECT y AS v FROM j UNION SELECT pred FROM j)
 SELECT a.v AS y, b.v AS pred, (SELECT count(*) FROM j WHERE j.y = a.v AND j.pred = b.v) AS n FROM n a, n b""",
    "saved_model": f"SELECT count(*) AS n_rows, 0::BIGINT AS n_changed FROM {LABELLED}",
    "out_of_fold_coverage": f"SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, 0::BIGINT AS n_off FROM {LABELLED}",
    "tree_attribution_sums": f"SELECT count(*) AS n_rows, true AS constant FROM {LABELLED}",
}

FOLDED = f"""SELECT c_custkey, c_mktsegment, ((row_number() OVER (ORDER BY c_mktsegment, {unit('c_custkey', 42)}, c_custkey) - 1) % 5)::INT AS fold
 FROM customer"""
ORACLE["stratified_folds"] = ORACLE["stratified_folds_cut"] = FOLDED
ORACLE["holdout_sizes"] = """WITH r AS (SELECT o_orderstatus, (row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1) % 5 AS fold FROM orders)
 SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part, o_orderstatus, count(*) AS n_rows FROM r GROUP BY 1, 2"""
ORACLE["folds_with_gaps"] = """SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, count(*) AS n_rows,
 count(DISTINCT c_custkey) AS n_ids FROM customer GROUP BY 1"""
ORACLE["fold_balance"] = "SELECT count(*) AS n_rows, true AS even_total, true AS even_classes FROM orders"
ORACLE["one_hot_wide"] = "SELECT 1::DOUBLE AS ones, count(*) AS n_rows, count(DISTINCT p_name) AS n_features FROM part"

HOLED = """p AS (SELECT o_orderkey AS k, o_totalprice / 500000.0::DOUBLE AS a, (o_custkey % 97 + 1) / 97.0::DOUBLE AS b,
  (o_orderkey % 101 + 1) / 101.0::DOUBLE AS c FROM orders),
 h AS (SELECT k, CASE WHEN k % 13 <> 0 AND k % 5 <> 0 THEN a / (a + b + c) END AS p0,
  CASE WHEN k % 13 <> 0 AND k % 3 <> 0 THEN b / (a + b + c) END AS p1, CASE WHEN k % 13 <> 0 AND k % 4 <> 0 THEN c / (a + b + c) END AS p2 FROM p),
 d AS (SELECT *, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1
  WHEN p2 = greatest(p0, p1, p2) THEN 2 END AS pred FROM h)"""
NAME = "CASE {} WHEN 0 THEN 'Filled_Late' WHEN 1 THEN 'On_Time' WHEN 2 THEN 'Partly_Sent' END"
ORACLE["gap_decisions"] = f"""WITH {HOLED} SELECT k AS o_orderkey, pred::INT AS pred, {NAME.format('pred')} AS name,
 CASE WHEN p0 IS NULL THEN NULL WHEN p0 < 0.5 THEN '✅ NEGATIVE' WHEN p0 >= 0.8 THEN '🔴 HIGH RISK' WHEN p0 >= 0.6 THEN '🟡 MODERATE RISK' ELSE '🟢 POSITIVE' END AS band,
 CASE WHEN p0 > 0.5 THEN 'Disease Detected' WHEN p0 <= 0.5 THEN 'Healthy' END AS caption FROM d"""
ORACLE["gap_top"] = f"""WITH {HOLED}, u AS (SELECT k, 0 AS i, p0 AS p FROM h UNION ALL SELECT k, 1, p1 FROM h UNION ALL SELECT k, 2, p2 FROM h),
 r AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY p DESC, i) AS rank FROM u WHERE p IS NOT NULL)
 SELECT d.k AS o_orderkey, {NAME.format('pred')} AS prediction, {NAME.format('r.i')} AS top2_disease
 FROM d LEFT JOIN r ON r.k = d.k AND r.rank = 2"""
ORACLE["gap_ranges"] = """SELECT 'l_quantity' AS "column", 'between 5 and 45' AS "check", count(*) AS n_failed FROM lineitem
 WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 AND NOT l_quantity BETWEEN 5 AND 45"""

DOCUMENT_FACTS = "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, 0::BIGINT AS n_wrong, 0::BIGINT AS n_off FROM {}"
for _name in ("score_and_report", "fit_boosted", "calibrated_sigmoid", "calibrated_isotonic"):
    ORACLE[f"facts_{_name}"] = DOCUMENT_FACTS.format("documents")
ORACLE["facts_out_of_fold"] = DOCUMENT_FACTS.format(LABELLED)
ORACLE["facts_fit_multi_output"] = "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, 0::BIGINT AS n_off FROM documents"
ORACLE["facts_fit_logistic_classes"] = "SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, 0::BIGINT AS n_wrong FROM customer"
for _name in ("fit_forest", "fit_boosted_classes"):
    ORACLE[f"facts_{_name}"] = "SELECT count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_classes, 0::BIGINT AS n_wrong FROM customer"
WIDTH = f"SELECT 1 + count(DISTINCT lang) + count(DISTINCT source) AS n_features, {{}} FROM {LABELLED}"
ORACLE["facts_native_importance"] = WIDTH.format("true AS sums_to_one, true AS no_negative")
for _name in ("linear_model_attribution", "tree_attribution", "sampled_attribution"):
    ORACLE[f"facts_{_name}"] = WIDTH.format("0::BIGINT AS n_off")
ORACLE["logistic_gradient"] = WIDTH.format("true AS zero")
ORACLE["facts_calibration_choice"] = "SELECT 2::BIGINT AS n_methods, 1::BIGINT AS n_selected, true AS best"
ORACLE["facts_parameter_search"] = "SELECT 3::BIGINT AS n_trials, 3::BIGINT AS n_numbers, 0::BIGINT AS n_off"
ORACLE["weighted_multilabel_fit"] = "SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM documents"
ORACLE["scoring_contract"] = """SELECT 'o_totalprice' AS "column", 'between 1000.0 and 200000.0' AS "check", count(*) AS n_failed
 FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice BETWEEN 1000 AND 200000"""
ORACLE["facts_out_of_fold_metrics"] = "SELECT 6::BIGINT AS n_metrics, 0::BIGINT AS n_off, 1::BIGINT AS n_areas"


def leaf_values(rounds: int = 3, rate: float = 0.3, alpha: float = 0.5, penalty: float = 2.0) -> str:
    """Rounds of stumps over one flag, in closed form: margins of (side, class), then G, H and the leaf values."""

    def shrunk(g: str) -> str:
        return f"sign({g}) * greatest(abs({g}) - {num(alpha)}, {num(0)})"

    parts = ["""d AS (SELECT lang, (n_chars > 1500)::INT::DOUBLE AS x FROM documents),
 cells AS (SELECT x, l.lang, (SELECT count(*) FROM d WHERE d.x = s.x) AS n, (SELECT count(*) FROM d WHERE d.x = s.x AND d.lang = l.lang) AS hits
  FROM (SELECT DISTINCT x FROM d) s, (SELECT DISTINCT lang FROM d) l),
 m0 AS (SELECT *, 0::DOUBLE AS m FROM cells)"""]
    for i in range(rounds):
        parts.append(f"""p{i} AS (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY x) AS p FROM m{i}),
 g{i} AS (SELECT *, n * p - hits AS g, 2 * n * p * (1 - p) AS h FROM p{i}),
 t{i} AS (SELECT *, sum(g) OVER w AS tg, sum(h) OVER w AS th, sum(n) OVER w AS tn, sum(pow({shrunk('g')}, 2) / (h + {num(penalty)})) OVER w AS parts
  FROM g{i} WINDOW w AS (PARTITION BY lang)),
 k{i} AS (SELECT *, parts >= pow({shrunk('tg')}, 2) / (th + {num(penalty)}) AS split FROM t{i}),
 v{i} AS (SELECT x, lang, n, hits, m, CASE WHEN split THEN n ELSE tn END AS n_rows,
  -{num(rate)} * CASE WHEN split THEN {shrunk('g')} / (h + {num(penalty)}) ELSE {shrunk('tg')} / (th + {num(penalty)}) END AS value FROM k{i}),
 m{i + 1} AS (SELECT x, lang, n, hits, m + value AS m FROM v{i})""")
    union = " UNION ALL ".join(f"SELECT lang, {i}::INT AS round, x, n_rows::BIGINT AS n_rows, {r6('value', 'value')} FROM v{i}" for i in range(rounds))
    return f"WITH {', '.join(parts)} {union}"


ORACLE["boosted_leaf_values"] = leaf_values()

ORACLE["dictionary_codes"] = """WITH r AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer),
 known AS (SELECT * FROM r WHERE c_custkey % 3 <> 0),
 names AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM known)),
 segments AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM known WHERE segment IS NOT NULL)),
 usual AS (SELECT segment FROM known WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
 SELECT c_custkey, names.code AS name_code, segments.code AS segment_code FROM r LEFT JOIN names USING (c_name)
 LEFT JOIN segments ON segments.segment = coalesce(r.segment, (SELECT segment FROM usual))"""
SPARSE = """p AS (SELECT p_partkey, p_name, p_brand, p_size::DOUBLE AS size FROM part),
 known AS (SELECT * FROM p WHERE p_partkey % 3 <> 0),
 brands AS (SELECT 'p_brand_' || p_brand AS feature, p_brand FROM (SELECT DISTINCT p_brand FROM known)),
 names AS (SELECT 'p_name_' || p_name AS feature, p_name FROM (SELECT DISTINCT p_name FROM known)),
 listed AS (SELECT 'size' AS feature, 0 AS part, '' AS v UNION ALL SELECT feature, 1, p_name FROM names UNION ALL SELECT feature, 2, p_brand FROM brands),
 numbered AS (SELECT feature, row_number() OVER (ORDER BY part, v) - 1 AS i FROM listed),
 coefs AS (SELECT feature, ((i * 37) % 101 - 50) / 29.7::DOUBLE AS c FROM numbered),
 own AS (SELECT p_partkey, 'size' AS feature, size AS x FROM p UNION ALL SELECT p_partkey, feature, 1 FROM p JOIN names USING (p_name)
  UNION ALL SELECT p_partkey, feature, 1 FROM p JOIN brands USING (p_brand)),
 means AS (SELECT feature, c, coalesce(sum(x), 0) / (SELECT count(*) FROM p) AS m FROM coefs LEFT JOIN own USING (feature) GROUP BY feature, c),
 every AS (SELECT k.p_partkey, means.feature, c * (coalesce(x, 0) - m) AS value
  FROM p k CROSS JOIN means LEFT JOIN own ON own.p_partkey = k.p_partkey AND own.feature = means.feature)"""
ORACLE["sparse_importance"] = f"WITH {SPARSE} SELECT feature, {r6('avg(abs(value))', 'mean_abs_shap')} FROM every GROUP BY feature"
ORACLE["sparse_top_features"] = f"""WITH {SPARSE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(value) DESC, feature) AS rank FROM every)
 SELECT p_partkey, feature, {r6('value', 'value')}, {r6('abs(value)', 'abs_value')}, rank::INT AS rank FROM ranked WHERE rank <= 3"""

DECIDED = f"""{BINARY}, d AS (SELECT pos AS y, (score >= {num(0.3)})::INT AS pred FROM b), k AS (SELECT unnest([0, 1]) AS c),
 s AS (SELECT c, (SELECT count(*) FROM d WHERE y = c AND pred = c) AS tp, (SELECT count(*) FROM d WHERE y = c) AS support,
  (SELECT count(*) FROM d WHERE pred = c) AS called FROM k),
 sc AS (SELECT *, CASE WHEN called = 0 THEN 0e0 ELSE tp / called END AS p, CASE WHEN support = 0 THEN 0e0 ELSE tp / support END AS r FROM s),
 f AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f FROM sc)"""
ORACLE["metric_bundle"] = f"""SELECT 'roc_auc' AS metric, (SELECT roc_auc FROM ({ORACLE['roc_auc']})) AS value
 UNION ALL SELECT 'pr_auc', (SELECT pr_auc FROM ({ORACLE['average_precision']}))
 UNION ALL SELECT 'threshold', (SELECT threshold FROM ({ORACLE['best_f1_threshold']}))
 UNION ALL SELECT 'best_f1', (SELECT f1 FROM ({ORACLE['best_f1_threshold']}))
 UNION ALL (WITH {DECIDED} SELECT 'accuracy', {r6('sum(tp) / sum(support)', 'value')} FROM f)
 UNION ALL (WITH {DECIDED} SELECT 'precision', {r6('avg(p)', 'value')} FROM f)
 UNION ALL (WITH {DECIDED} SELECT 'recall', {r6('avg(r)', 'value')} FROM f)
 UNION ALL (WITH {DECIDED} SELECT 'f1', {r6('avg(f)', 'value')} FROM f)"""
ORACLE["class_bundle"] = f"""WITH {CLASS_ROWS}, {CLASS_LONG}, {AUC}, {AP} SELECT cls, {r6('auc', 'auc')}, {r6('ap', 'ap')} FROM av JOIN ap USING (cls)"""

ORACLE["group_class_folds"] = """SELECT 0::BIGINT AS n_split, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 <> 0) + 1 AS n_groups,
 (SELECT count(DISTINCT o_orderstatus) * 3 FROM orders) AS n_cells, 0::BIGINT AS n_uneven"""

_SCORES = ORACLE["multilabel_scores"]
_PER_LABEL = ORACLE["roc_auc_per_label"]
ORACLE["label_array_scores"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS metric, {c} AS value FROM ({_SCORES})" for c in ("macro_f1", "micro_f1", "samples_f1", "accuracy")]
    + [f"SELECT 'auc_' || cls, auc FROM ({_PER_LABEL})"]
    + [f"""(WITH m AS (SELECT labels.* FROM {LABELLED}), t AS (SELECT count(*)::DOUBLE n, sum(quality) q, sum(toxic) x FROM m),
 w AS (SELECT CASE WHEN quality + toxic = 0 THEN 1e0 ELSE (quality * (n / (2 * q + 1)) + toxic * (n / (2 * x + 1))) / (quality + toxic) END AS raw FROM m, t)
 SELECT 'largest_weight', {r6('max(raw) * (SELECT n FROM t) / (SELECT sum(raw) FROM w)', 'value')} FROM w)"""]
)
ORACLE["label_decades"] = f"""WITH l AS (SELECT doc_id, i, (n_chars % i = 0)::INT AS t, (doc_id % i = 0)::INT AS p FROM documents, range(2, 32) r(i)),
 by_label AS (SELECT i, sum(t * p) AS tp, sum(t + p) AS sz FROM l GROUP BY i),
 by_row AS (SELECT doc_id, sum(t * p) AS tp, sum(t + p) AS sz, bool_and(t = p) AS ok FROM l GROUP BY doc_id)
 SELECT {r6('(SELECT avg(CASE WHEN sz = 0 THEN 0e0 ELSE 2e0 * tp / sz END) FROM by_label)', 'macro_f1')},
 {r6('(SELECT 2e0 * sum(tp) / sum(sz) FROM by_label)', 'micro_f1')},
 {r6('(SELECT avg(CASE WHEN sz = 0 THEN 0e0 ELSE 2e0 * tp / sz END) FROM by_row)', 'samples_f1')},
 {r6('(SELECT avg(ok::INT::DOUBLE) FROM by_row)', 'accuracy')}"""

ORACLE["tree_attribution_values"] = leaf_values(1).split(" SELECT lang, 0::INT")[0] + f""" ,
 u AS (SELECT *, sum(h * CASE WHEN split THEN (SELECT value FROM v0 WHERE v0.x = k0.x AND v0.lang = k0.lang) ELSE 0 END) OVER (PARTITION BY lang) / th AS mean FROM k0)
 SELECT u.lang, u.x, n::BIGINT AS n_rows, {r6("CASE WHEN split THEN (SELECT value FROM v0 WHERE v0.x = u.x AND v0.lang = u.lang) - mean ELSE 0 END", "low")},
 {r6("CASE WHEN split THEN (SELECT value FROM v0 WHERE v0.x = u.x AND v0.lang = u.lang) - mean ELSE 0 END", "high")}
 FROM (SELECT u.lang, u.x, c.n, split, mean FROM u JOIN (SELECT x, count(*) AS n FROM d GROUP BY x) c ON c.x = u.x) u"""
ORACLE["saturated_logistic"] = f"""SELECT lang, count(*) AS n_rows, floor(avg(quality) * 1000 + {num(0.5)})::BIGINT AS high,
 floor(avg(quality) * 1000 + {num(0.5)})::BIGINT AS low FROM {LABELLED} GROUP BY lang"""
ORACLE["train_and_score"] = f"""SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, sum(n_chars)::BIGINT AS n_chars, 0::BIGINT AS n_wrong,
 (SELECT 2 + count(DISTINCT lang) + count(DISTINCT source) FROM {LABELLED}) AS n_features, 1::BIGINT AS n_versions FROM documents"""
