"""G: splits, bins, association screens and temporal analytics."""

from pyspark.sql import functions as F

from tidegauge.bindings.common import CLASS_NAMES, CLASSES, FEATURES, LINE_KEY, LINES_SQL, lines, unpivot_sql
from tidegauge.bindings.distribution import ETA_SQL
from tidegauge.bindings.registry import query
from tidegauge.functions.ordering import number_rows
from tidegauge.operators import association as A
from tidegauge.operators import binning as B
from tidegauge.operators import distribution as G
from tidegauge.operators import splits as S
from tidegauge.operators import temporal as T

PART_SQL = f"SELECT *, CASE WHEN l_shipdate < TIMESTAMP '2000-06-16' THEN 'train' ELSE 'test' END AS part FROM ({LINES_SQL})"


def parted(t):
    """lines with a fixed-date split, for operators that take the partition as given."""
    return lines(t).withColumn("part", F.when(F.col("l_shipdate") < F.lit("2000-06-16").cast("timestamp_ntz"), "train").otherwise("test"))


def train(t):
    return parted(t).filter("part = 'train'")


def chrono_sql(source: str, key: str, size: str) -> str:
    return f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {key}) <= CAST(floor((SELECT count(*) FROM ({source})) * {size}) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM ({source})"


SPLIT_SQL = chrono_sql(LINES_SQL, ", ".join(LINE_KEY), "0.8")
COUNT_PARTS = "SELECT part, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM ({0}) GROUP BY part"


def count_parts(df):
    return df.groupBy("part").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
                                  F.sum("l_orderkey").alias("keys"))


@query("g01_chronological_split", f"SELECT l_orderkey, l_linenumber, l_partkey, part FROM ({SPLIT_SQL})")
def _(t):
    return S.chronological_split(lines(t), LINE_KEY).select("l_orderkey", "l_linenumber", "l_partkey", "part")


@query("g01_event_split", f"SELECT part, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM ({chrono_sql('SELECT * FROM events', 'ts', '0.7')}) GROUP BY part")
def _(t):
    return S.chronological_split(t.events, "ts", 0.3).groupBy("part").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("g02_cutoff_split", COUNT_PARTS.format(f"""SELECT *, CASE WHEN l_shipdate < (SELECT l_shipdate FROM lineitem ORDER BY l_shipdate
  LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM lineitem)) THEN 'train' ELSE 'test' END AS part FROM ({LINES_SQL})"""))
def _(t):
    return count_parts(S.cutoff_split(lines(t), "l_shipdate"))


@query("g03_nested_split", COUNT_PARTS.format(f"""SELECT * EXCLUDE (part, r), CASE WHEN part = 'test' THEN 'test'
  WHEN r <= CAST(floor((SELECT count(*) FROM ({SPLIT_SQL}) WHERE part = 'train') * 0.8) AS BIGINT) THEN 'fit' ELSE 'validation' END AS part
  FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) AS r FROM ({SPLIT_SQL}))"""))
def _(t):
    return count_parts(S.nested_split(lines(t), LINE_KEY))


GLONG = f"glong AS ({unpivot_sql(PART_SQL, FEATURES, 'part, cls, y')})"


def edges_cte(k: int, source: str = "glong") -> str:
    probs = ", ".join(str(i / k) for i in range(k + 1))
    return f"edges{k} AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS e FROM {source} WHERE part = 'train' GROUP BY feature)"


def bin_sql(value: str, edges: str) -> str:
    return f"CAST(len(list_filter({edges}[2:len({edges}) - 1], lambda x: x <= {value})) AS INTEGER)"


BINNED = f"binned AS (SELECT g.*, {bin_sql('value', 'e')} AS bin FROM glong g JOIN edges10 USING (feature))"
BINS = "bins AS (SELECT feature, CAST(unnest(range(len(e) - 1)) AS INTEGER) AS bin FROM edges10)"


@query("g04_quantile_edges", f"WITH {GLONG}, {edges_cte(10)} SELECT feature, CAST(i AS INTEGER) AS position, e[i] AS edge FROM edges10, (SELECT unnest(range(1, 12)) AS i) WHERE i <= len(e)", "edge")
def _(t):
    return B.quantile_edges(train(t), FEATURES, 10).select("feature", F.posexplode("edges").alias("at", "edge")).select(
        "feature", (F.col("at") + 1).alias("position"), "edge")


@query("g05_assign_bins", f"WITH {GLONG}, {edges_cte(10)}, {BINNED} SELECT feature, bin, part, count(*) AS n FROM binned GROUP BY ALL")
def _(t):
    edges = B.fit_edges(train(t), FEATURES, 10)
    return B._long_bins(parted(t), edges, ["part"]).groupBy("feature", "bin", "part").agg(F.count("*").alias("n"))


RATES_SQL = """SELECT feature, bin, coalesce(count(y) FILTER (part = 'train'), 0) AS train_count, coalesce(avg(y) FILTER (part = 'train'), 0) AS train_rate,
  coalesce(count(y) FILTER (part = 'test'), 0) AS test_count, coalesce(avg(y) FILTER (part = 'test'), 0) AS test_rate
  FROM bins LEFT JOIN binned USING (feature, bin) GROUP BY feature, bin"""


@query("g06_binned_rates", f"WITH {GLONG}, {edges_cte(10)}, {BINNED}, {BINS} {RATES_SQL}", "train_rate test_rate")
def _(t):
    return B.binned_rates(parted(t), B.fit_edges(train(t), FEATURES, 10), "y", "part")


SPREAD_SQL = f"SELECT feature, max(train_rate) - min(train_rate) AS train_spread, max(test_rate) - min(test_rate) AS test_spread FROM ({RATES_SQL}) GROUP BY feature"


@query("g07_rate_spread", f"WITH {GLONG}, {edges_cte(10)}, {BINNED}, {BINS} {SPREAD_SQL}", "train_spread test_spread")
def _(t):
    return B.rate_spread(B.binned_rates(parted(t), B.fit_edges(train(t), FEATURES, 10), "y", "part"))


def wide_bins(source: str) -> str:
    cells = ", ".join(f"{bin_sql(f, f'e_{f}')} AS b_{f}" for f in FEATURES)
    lists = ", ".join(f"max(e) FILTER (feature = '{f}') AS e_{f}" for f in FEATURES)
    return f"wb AS (SELECT part, cls, y, {cells} FROM {source}, (SELECT {lists} FROM edges5))"


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
PAIR_ROWS = "pr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, b_{a} AS a, b_{b} AS b, part, cls, y FROM wb" for a, b in PAIRS) + ")"
PAIR_RATE_SQL = """SELECT feature_a, feature_b, coalesce(max(abs(rtr - btr)) FILTER (ntr >= 100), 0) AS train_deviation,
  coalesce(max(abs(rte - bte)) FILTER (nte >= 100), 0) AS test_deviation,
  CASE WHEN count(*) FILTER (ntr >= 100 AND nte >= 100) >= 2 AND stddev_samp(rtr) FILTER (ntr >= 100 AND nte >= 100) > 0
    AND stddev_samp(rte) FILTER (ntr >= 100 AND nte >= 100) > 0 THEN corr(rtr, rte) FILTER (ntr >= 100 AND nte >= 100) ELSE 0 END AS agreement
  FROM (SELECT feature_a, feature_b, a, b, count(*) FILTER (part = 'train') AS ntr, count(*) FILTER (part = 'test') AS nte,
    avg(y) FILTER (part = 'train') AS rtr, avg(y) FILTER (part = 'test') AS rte FROM pr GROUP BY ALL),
    (SELECT avg(y) FILTER (part = 'train') AS btr, avg(y) FILTER (part = 'test') AS bte FROM wb) GROUP BY feature_a, feature_b"""


@query("g08_pair_rate_deviation", f"WITH {GLONG}, {edges_cte(5)}, {wide_bins(f'({PART_SQL})')}, {PAIR_ROWS} {PAIR_RATE_SQL}", "train_deviation test_deviation agreement")
def _(t):
    return B.pair_rate_deviation(parted(t), B.fit_edges(train(t), FEATURES, 5), "y", "part")


CLASS_RATES = ", ".join(f"""count(cls) FILTER (part = '{p}') AS {p}_count, """ + ", ".join(
    f"coalesce(count(cls) FILTER (part = '{p}' AND cls = {c}) / nullif(CAST(count(cls) FILTER (part = '{p}') AS DOUBLE), 0), 0) AS {p}_rate_{c}" for c in CLASSES)
    for p in ("train", "test"))
CLASS_RATES_SQL = f"SELECT feature, bin, {CLASS_RATES} FROM bins LEFT JOIN binned USING (feature, bin) GROUP BY feature, bin"
RATE_COLUMNS = " ".join(f"{p}_rate_{c}" for p in ("train", "test") for c in CLASSES)


@query("g09_class_rates_by_bin", f"WITH {GLONG}, {edges_cte(10)}, {BINNED}, {BINS} {CLASS_RATES_SQL}", RATE_COLUMNS)
def _(t):
    return B.class_rates_by_bin(parted(t), B.fit_edges(train(t), FEATURES, 10), "cls", CLASSES, "part")


@query("p17_class_rate_ratio", f"""WITH {GLONG}, {edges_cte(10)}, {BINNED}, {BINS}, r AS ({CLASS_RATES_SQL})
  SELECT feature, bin, {', '.join(f"{p}_rate_{c} / (SELECT avg(CAST(cls = {c} AS INTEGER)) FROM ({PART_SQL}) WHERE part = '{p}') AS {p}_ratio_{c}" for p in ('train', 'test') for c in CLASSES)}
  FROM r""", " ".join(f"{p}_ratio_{c}" for p in ("train", "test") for c in CLASSES))
def _(t):
    df = parted(t)
    rates = B.class_rates_by_bin(df, B.fit_edges(train(t), FEATURES, 10), "cls", CLASSES, "part")
    return B.class_rate_ratio(rates, B.class_distribution(df, "cls", CLASSES, "part"), CLASSES)


def pattern_sql() -> str:
    def counts(p):
        return f"count(*) FILTER (part = '{p}') AS n_{p}, " + ", ".join(f"count(*) FILTER (part = '{p}' AND cls = {c}) AS k_{p}_{c}" for c in CLASSES)

    def prior(p):
        return ", ".join(f"avg(CAST(cls = {c} AS INTEGER)) FILTER (part = '{p}') AS p_{p}_{c}" for c in CLASSES)

    def residual(p, c):
        return f"(coalesce(k_{p}_{c} / nullif(CAST(n_{p} AS DOUBLE), 0), 0) - p_{p}_{c})"

    def tv(p):
        return "(" + " + ".join(f"abs({residual(p, c)})" for c in CLASSES) + ") / 2"

    res = " UNION ALL ".join(f"SELECT feature_a, feature_b, {residual('train', c)} AS x, {residual('test', c)} AS y FROM c, pri WHERE n_train >= 100 AND n_test >= 100"
                             for c in CLASSES)
    return f"""c AS (SELECT feature_a, feature_b, a, b, {counts('train')}, {counts('test')} FROM pr GROUP BY ALL),
  pri AS (SELECT {prior('train')}, {prior('test')} FROM wb), res AS ({res}),
  ag AS (SELECT feature_a, feature_b, CASE WHEN count(*) >= {2 * len(CLASSES)} AND stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN corr(x, y) END AS agreement FROM res GROUP BY ALL)
  SELECT feature_a, feature_b, coalesce(max({tv('train')}) FILTER (n_train >= 100), 0) AS train_deviation, coalesce(max({tv('test')}) FILTER (n_test >= 100), 0) AS test_deviation,
  coalesce(any_value(agreement), 0) AS agreement FROM c CROSS JOIN pri LEFT JOIN ag USING (feature_a, feature_b) GROUP BY feature_a, feature_b"""


@query("g10_pair_class_pattern", f"WITH {GLONG}, {edges_cte(5)}, {wide_bins(f'({PART_SQL})')}, {PAIR_ROWS}, {pattern_sql()}", "train_deviation test_deviation agreement")
def _(t):
    return B.pair_class_pattern(parted(t), B.fit_edges(train(t), FEATURES, 5), "cls", CLASSES, "part")


TRAIN = "FROM glong WHERE part = 'train'"
GROUP_STATS = ["count(*)", "avg(value)", "quantile_cont(value, 0.5)", "stddev_samp(value)", "quantile_cont(value, 0.05)", "quantile_cont(value, 0.25)",
               "quantile_cont(value, 0.75)", "quantile_cont(value, 0.95)"]
GROUP_NAMES = ["n", "mean", "median", "sd", "q05", "q25", "q75", "q95"]
TWO_SQL = "SELECT feature, " + ", ".join(f"{s} FILTER (y = {g}) AS {n}_{g}" for s, n in zip(GROUP_STATS, GROUP_NAMES) for g in (0, 1)) + \
    f", avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0) AS mean_difference {TRAIN} GROUP BY feature"
TWO_DOUBLES = " ".join(f"{n}_{g}" for n in GROUP_NAMES[1:] for g in (0, 1)) + " mean_difference"


@query("g11_two_group_summary", f"WITH {GLONG} {TWO_SQL}", TWO_DOUBLES)
def _(t):
    return A.two_group_summary(train(t), FEATURES, "y")


@query("g12_class_feature_summary", f"WITH {GLONG} SELECT feature, cls AS class, " + ", ".join(f"{s} AS {n}" for s, n in zip(GROUP_STATS, GROUP_NAMES)) +
       " FROM glong GROUP BY feature, cls", " ".join(GROUP_NAMES[1:]))
def _(t):
    return A.class_summary(lines(t), FEATURES, "cls")


@query("g13_class_distribution", f"""SELECT k.part, k.class, CASE k.class WHEN 0 THEN 'Accepted' WHEN 1 THEN 'None' ELSE 'Returned' END AS class_name, count(s.cls) AS n,
  count(s.cls) / CAST(sum(count(s.cls)) OVER (PARTITION BY k.part) AS DOUBLE) AS share
  FROM (SELECT * FROM (VALUES ('train'), ('test')) AS a(part), (VALUES (0), (1), (2)) AS b(class)) k LEFT JOIN ({PART_SQL}) s ON s.part = k.part AND s.cls = k.class GROUP BY k.part, k.class""", "share")
def _(t):
    return B.class_distribution(parted(t), "cls", CLASSES, "part", CLASS_NAMES)


COHEN_SQL = """SELECT feature, CASE WHEN v = 0 THEN 0 ELSE (mean_1 - mean_0) / sqrt(v) END AS cohens_d FROM (SELECT *,
  ((n_0 - 1) * sd_0 * sd_0 + (n_1 - 1) * sd_1 * sd_1) / (n_0 + n_1 - 2) AS v FROM ({0}))"""


@query("g14_cohens_d", f"WITH {GLONG} {COHEN_SQL.format(TWO_SQL)}", "cohens_d")
def _(t):
    return A.cohens_d(A.two_group_summary(train(t), FEATURES, "y"))


@query("g14_constant_feature", f"WITH {GLONG} SELECT DISTINCT 'flat' AS feature, 0.0::DOUBLE AS cohens_d {TRAIN}", "cohens_d")
def _(t):
    return A.cohens_d(A.two_group_summary(train(t).withColumn("flat", F.lit(0.25)), ["flat"], "y"))


R_SQL = f"SELECT feature, corr(value, y) AS r {TRAIN} GROUP BY feature"


@query("g15_point_biserial", f"WITH {GLONG} {R_SQL}", "r")
def _(t):
    return A.point_biserial(train(t), FEATURES, "y")


def auc_sql(source: str, keys: str, score: str, positive: str) -> str:
    """Rank-sum AUC per key: ties count half."""
    return f"""SELECT {keys}, sum(p * (below + 0.5 * q)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {keys} ORDER BY s
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {keys}, {score} AS s, CAST(count(*) FILTER ({positive}) AS DOUBLE) AS p,
  CAST(count(*) FILTER (NOT ({positive})) AS DOUBLE) AS q FROM {source} GROUP BY ALL)) GROUP BY {keys}"""


TRAIN_ROWS = "(SELECT * FROM glong WHERE part = 'train')"
AUC_SQL = f"SELECT feature, greatest(auc, 1 - auc) AS auc FROM ({auc_sql(TRAIN_ROWS, 'feature', 'value', 'y = 1')})"


@query("g16_univariate_auc", f"WITH {GLONG} {AUC_SQL}", "auc")
def _(t):
    return A.univariate_auc(train(t), FEATURES, "y")


OVR_SQL = "SELECT feature, class, greatest(auc, 1 - auc) AS auc FROM (" + auc_sql(
    f"(SELECT feature, value, cls, k.class FROM {TRAIN_ROWS}, (VALUES (0), (1), (2)) AS k(class))", "feature, class", "value", "cls = class") + ")"


@query("g17_one_vs_rest_auc", f"WITH {GLONG} {OVR_SQL}", "auc")
def _(t):
    return A.one_vs_rest_auc(train(t), FEATURES, "cls", CLASSES)


OVR_SUMMARY_SQL = f"""SELECT feature, avg(auc) AS macro_auc, max(auc) AS best_auc, min(class) FILTER (rk = 1) AS best_class FROM
  (SELECT *, rank() OVER (PARTITION BY feature ORDER BY auc DESC) AS rk FROM ({OVR_SQL})) GROUP BY feature"""


@query("g17_auc_summary", f"WITH {GLONG} {OVR_SUMMARY_SQL}", "macro_auc best_auc")
def _(t):
    return A.auc_summary(A.one_vs_rest_auc(train(t), FEATURES, "cls", CLASSES))


ETA0_SQL = f"SELECT feature, coalesce(eta_squared, 0) AS eta_squared FROM ({ETA_SQL.format('cls')})"


@query("g18_eta_squared", f"WITH long AS (SELECT * FROM ({unpivot_sql('SELECT *, 0.5 AS flat FROM (' + PART_SQL + ')', [*FEATURES, 'flat'], 'cls, part')}) WHERE part = 'train') {ETA0_SQL}",
       "eta_squared", decimals=9)
def _(t):
    return G.eta_squared(train(t).withColumn("flat", F.lit(0.5)), [*FEATURES, "flat"], "cls", undefined_zero=True)


def mi_sql(label: str) -> str:
    return f"""SELECT feature, greatest(sum(n / t * ln(n * t / (nb * nc))), 0) AS mutual_information FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t,
  sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, {label}) AS nc
  FROM (SELECT feature, bin, {label}, CAST(count(*) AS DOUBLE) AS n FROM binned WHERE part = 'train' GROUP BY ALL)) GROUP BY feature"""


@query("g19_mutual_information", f"WITH {GLONG}, {edges_cte(10)}, {BINNED} {mi_sql('cls')}", "mutual_information", decimals=9)
def _(t):
    return A.mutual_information(train(t), FEATURES, "cls")


@query("g20_top_features", f"WITH {GLONG} SELECT feature, auc FROM ({AUC_SQL}) ORDER BY auc DESC LIMIT 2", "auc")
def _(t):
    return A.rank_features(A.univariate_auc(train(t), FEATURES, "y"), "auc", FEATURES, 2)


@query("g21_monthly_rate", f"SELECT last_day(l_shipdate) AS month, count(y) AS n, avg(y) AS rate FROM ({LINES_SQL}) GROUP BY 1 HAVING count(y) >= 500", "rate")
def _(t):
    return T.monthly_rate(lines(t), "l_shipdate", "y", 500)


@query("g22_monthly_means", f"SELECT last_day(l_shipdate) AS month, count(y) AS n, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM ({LINES_SQL}) GROUP BY 1 HAVING count(y) >= 500", " ".join(FEATURES))
def _(t):
    return T.monthly_means(lines(t), "l_shipdate", FEATURES, "y", 500)


@query("g23_monthly_class_shares", f"""SELECT last_day(l_shipdate) AS month, count(cls) AS n, {', '.join(f'avg(CAST(cls = {c} AS INTEGER)) AS "{c}_{n}"' for c, n in CLASS_NAMES.items())}
  FROM ({LINES_SQL}) GROUP BY 1 HAVING count(cls) >= 500""", " ".join(f'"{c}_{n}"' for c, n in CLASS_NAMES.items()))
def _(t):
    return T.monthly_class_shares(lines(t), "l_shipdate", "cls", CLASS_NAMES, 500)


LAGS = [1, 4, 96, 672]
SERIES_SQL = "SELECT ts, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS x FROM events"


def lag_sql(source: str, value: str, k: int) -> str:
    return f"SELECT {value} AS x, lag({value}, {k}) OVER (ORDER BY ts) AS z FROM ({source})"


@query("g24_autocorrelation", " UNION ALL ".join(f"SELECT {k} AS lag, corr(x, z) AS r, count(z) AS n_pairs FROM ({lag_sql(SERIES_SQL, 'x', k)})" for k in LAGS), "r")
def _(t):
    df = t.events.select("ts", (F.col("event_type") == "error").cast("double").alias("x"))
    return T.autocorrelation(number_rows(df, ["ts"]), "obs", "x", LAGS)


TYPE_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
TYPED_SQL = "SELECT ts, CASE event_type " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in TYPE_CODES.items()) + " END AS cls FROM events"


@query("g25_class_autocorrelation", " UNION ALL ".join(f"""SELECT {c} AS class, {k} AS lag, CASE WHEN stddev_samp(x) > 0 AND stddev_samp(z) > 0 THEN corr(x, z) END AS r
  FROM (SELECT CAST(x = {c} AS INTEGER) AS x, CAST(z = {c} AS INTEGER) AS z FROM ({lag_sql(TYPED_SQL, 'cls', k)}) WHERE x IS NOT NULL AND z IS NOT NULL)""" for c in (0, 1, 4) for k in LAGS), "r")
def _(t):
    codes = F.create_map(*[F.lit(x) for p in TYPE_CODES.items() for x in p])
    df = t.events.select("ts", F.element_at(codes, F.col("event_type")).alias("cls"))
    return T.class_autocorrelation(number_rows(df, ["ts"]), "obs", "cls", [0, 1, 4], LAGS)


LEAK_SQL = f"WITH long AS ({unpivot_sql(LINES_SQL, ['l_suppkey', 'y'], 'cls')}), e AS ({ETA0_SQL}), m AS (SELECT feature, min(a) AS lo, max(a) AS hi FROM (SELECT feature, cls, avg(value) AS a FROM long GROUP BY ALL) GROUP BY feature)"


@query("g26_leakage_summary", f"""{LEAK_SQL} SELECT k."column", k.in_features, k.dtype, e.eta_squared, m.lo AS class_mean_min, m.hi AS class_mean_max
  FROM (VALUES ('l_shipdate', false, 'timestamp_ntz'), ('cls', false, 'int'), ('l_suppkey', false, 'bigint'), ('y', false, 'int')) AS k("column", in_features, dtype)
  LEFT JOIN e ON e.feature = k."column" LEFT JOIN m ON m.feature = k."column" """, "eta_squared class_mean_min class_mean_max")
def _(t):
    return A.leakage_summary(lines(t), ["l_shipdate", "cls", "l_suppkey", "y"], FEATURES, "cls")
