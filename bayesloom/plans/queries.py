"""Registered queries: one per operator family of SURVEY §2, each over whole driver tables.

``REGISTRY[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the same result in
plain SQL (DuckDB dialect) where the operator is expressible in SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayesloom.operators import counts as C
from bayesloom.operators import encode as E
from bayesloom.operators import scores as S
from bayesloom.operators import select as SEL
from bayesloom.operators import structure as K
from bayesloom.operators.cpt import cpt_check, cpt_check_summary, fit_cpts
from bayesloom.operators.predict import GaussianNB, bn_map_predict
from bayesloom.operators.sample import ancestral_sample, gaussian_nb_sample, union_labelled
from bayesloom.plans import oracle_sql as O
from bayesloom.session import cached
from bayesloom.plans import generator_sql, search_sql
from bayesloom.sources.tables import model_view, read

REGISTRY: dict = {}
ORACLE: dict = {}

LI_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def _li(spark, sf_dir):
    return model_view(spark, sf_dir, "li")


def _li_split(spark, sf_dir):
    v = _li(spark, sf_dir)
    return v, SEL.stratified_split(v.df, v.label, "row_key", 0.2, 42)


# ------------------------------------------------------------------ flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kDB(k=2) structure → CPTs → N synthetic rows → per-column marginals, real vs synthetic."""
    v = _li(spark, sf_dir)
    base = S.compacted(v.df, v.nodes)
    edges = K.kdb_structure(base, v.features, v.label, 2, weight="w", compacted=False)
    cpts = fit_cpts(base, edges, v.nodes, weight="w")
    n = int(base.agg(F.sum("w")).first()[0])
    syn = ancestral_sample(spark, cpts, edges, v.nodes, v.cards(), n, seed=42)
    real_m = C._long_values(v.df, v.nodes, "int").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_real"))
    syn_m = C._long_values(syn, v.nodes, "int").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_syn"))
    return (real_m.join(syn_m, ["column", "value"], "full_outer").fillna(0, ["n_real", "n_syn"])
            .withColumn("share_real", _r(F.col("n_real") / F.lit(n)))
            .withColumn("share_syn", _r(F.col("n_syn") / F.lit(n))))


# ------------------------------------------------------------------ P: encode / clean / split

@register("li_view", f"WITH {O.view_cte('li')} SELECT * FROM li")
def q_li_view(spark, d):
    """P5 + P1 + P6: the discrete model view of lineitem."""
    return _li(spark, d).df


@register("ord_view", f"WITH {O.view_cte('ord')} SELECT * FROM ord")
def q_ord_view(spark, d):
    return model_view(spark, d, "ord").df


@register("ev_view", f"WITH {O.view_cte('ev')} SELECT * FROM ev")
def q_ev_view(spark, d):
    return model_view(spark, d, "ev").df


@register("prt_view", f"WITH {O.view_cte('prt')} SELECT * FROM prt")
def q_prt_view(spark, d):
    return model_view(spark, d, "prt").df


@register("label_dictionary",
          " UNION ALL ".join(
              f"SELECT '{c}' AS col_name, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
              f"FROM (SELECT DISTINCT {c} AS v FROM lineitem)" for c in ["l_linestatus", "l_returnflag"]))
def q_label_dictionary(spark, d):
    """Sorted-distinct dictionaries."""
    li = read(spark, d, "lineitem")
    enc = E.CategoryEncoder.fit(li, ["l_linestatus", "l_returnflag"])
    return enc.dictionary(spark).withColumnRenamed("column", "col_name")


@register("ordinal_encode_train_test",
          f"WITH {O.view_cte('li')}, {O.split_cte('li')}, "
          "raw AS (SELECT " + LI_KEY + " AS row_key, l_linestatus, l_returnflag FROM lineitem), "
          "tr AS (SELECT raw.* FROM raw JOIN split USING (row_key) WHERE NOT is_test), "
          "te AS (SELECT raw.* FROM raw JOIN split USING (row_key) WHERE is_test), "
          "d1 AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_linestatus AS v FROM tr)), "
          "d2 AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_returnflag AS v FROM tr)) "
          "SELECT te.row_key, coalesce(d1.code, -1) AS l_linestatus, coalesce(d2.code, -1) AS l_returnflag "
          "FROM te LEFT JOIN d1 ON te.l_linestatus = d1.v LEFT JOIN d2 ON te.l_returnflag = d2.v")
def q_ordinal_encode(spark, d):
    """P2 (+P7): dictionary fitted on the train rows, applied to the test rows; unseen → −1."""
    v, sp = _li_split(spark, d)
    raw = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), "l_linestatus", "l_returnflag")
    flags = sp.select("row_key", "is_test")
    j = raw.join(flags, "row_key")
    enc = E.CategoryEncoder.fit(j.filter(~F.col("is_test")), ["l_linestatus", "l_returnflag"])
    return enc.transform(j.filter(F.col("is_test"))).select("row_key", "l_linestatus", "l_returnflag")


@register("ordinal_decode",
          "SELECT " + LI_KEY + " AS row_key, l_linestatus, l_returnflag FROM lineitem")
def q_ordinal_decode(spark, d):
    """Codes back to original values (decode ∘ encode = identity)."""
    v = _li(spark, d)
    coded = v.df.select("row_key", F.col("status").alias("l_linestatus"), F.col("target").alias("l_returnflag"))
    return v.encoder.inverse(coded)


@register("standard_scale",
          "SELECT " + LI_KEY + " AS row_key, " + ", ".join(
              f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}"
              for c in LI_DOUBLES) + " FROM lineitem")
def q_standard_scale(spark, d):
    """(x − mean) / population std."""
    li = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *LI_DOUBLES)
    sc = E.StandardScaler.fit(li, LI_DOUBLES)
    return sc.transform(li).select("row_key", *[_r(c).alias(c) for c in LI_DOUBLES])


@register("minmax_scale",
          "SELECT " + LI_KEY + " AS row_key, " + ", ".join(
              f"round((CAST({c} AS DOUBLE) - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)), 6) AS {c}"
              for c in LI_DOUBLES) + " FROM lineitem")
def q_minmax_scale(spark, d):
    """(x − min)/(max − min)."""
    li = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *LI_DOUBLES)
    sc = E.MinMaxScaler.fit(li, LI_DOUBLES)
    return sc.transform(li).select("row_key", *[_r(c).alias(c) for c in LI_DOUBLES])


@register("stratified_split",
          f"WITH {O.view_cte('li')}, {O.split_cte('li')} SELECT row_key, target, is_test FROM split")
def q_stratified_split(spark, d):
    """Exact per-class 20 % test share by hash order (no window over a whole class)."""
    _, sp = _li_split(spark, d)
    return sp.select("row_key", "target", "is_test")


@register("sample_rows",
          f"WITH {O.view_cte('li')} SELECT row_key FROM (SELECT row_key, row_number() OVER (ORDER BY "
          f"{O.u_sql('row_key', 'split')}, row_key) AS rn FROM li) WHERE rn <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM li)")
def q_sample_rows(spark, d):
    """int(N·0.1) rows without replacement by hash order."""
    v = _li(spark, d)
    return SEL.sample_rows(v.df, "row_key", frac=0.1, seed=42).select("row_key")


@register("sample_cap",
          f"WITH {O.view_cte('ord')} SELECT row_key, price_b, priority, target FROM (SELECT *, row_number() OVER (ORDER BY "
          f"{O.u_sql('row_key', 'split')}, row_key) AS rn FROM ord) WHERE rn <= 1000")
def q_sample_cap(spark, d):
    """A training table above 1000 rows shrunk to 1000 rows (a sampling operator)."""
    v = model_view(spark, d, "ord")
    return SEL.sample_cap(v.df, "row_key", 1000, 42)


@register("null_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(*) - count({c}) AS n_null FROM lineitem"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_DOUBLES, "l_returnflag", "l_linestatus", "l_shipdate"]))
def q_null_audit(spark, d):
    """Null count per column."""
    li = read(spark, d, "lineitem")
    return E.null_audit(li).withColumnRenamed("column", "col_name")


@register("drop_null_rows", "SELECT count(*) AS n_rows FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL "
          "AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL")
def q_drop_null_rows(spark, d):
    """Rows without any null."""
    return E.drop_null_rows(read(spark, d, "orders")).agg(F.count(F.lit(1)).alias("n_rows"))


_P16_COLS = ["l_linenumber", *LI_DOUBLES, "l_returnflag", "l_linestatus"]


@register("infer_discrete", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(DISTINCT {c}) AS n_distinct, {str(c not in ('l_returnflag', 'l_linestatus')).lower()} AS is_numeric, "
    f"({str(c in ('l_returnflag', 'l_linestatus')).lower()} OR count(DISTINCT {c}) < 10) AS is_discrete FROM lineitem" for c in _P16_COLS))
def q_infer_discrete(spark, d):
    """Discrete if not numeric or fewer than 10 distinct values."""
    li = read(spark, d, "lineitem")
    return E.infer_discrete_columns(li, _P16_COLS).withColumnRenamed("column", "col_name")


@register("feature_cards", f"WITH {O.view_cte('li')} " + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(DISTINCT {c}) AS card FROM li" for c in O.LI_NODES))
def q_feature_cards(spark, d):
    """Distinct values per column."""
    v = _li(spark, d)
    return E.feature_cards(v.df, v.nodes).withColumnRenamed("column", "col_name")


@register("class_counts", f"WITH {O.view_cte('li')} SELECT target, count(*) AS n, round(count(*) / (SELECT count(*) FROM li), 6) AS share FROM li GROUP BY target")
def q_class_counts(spark, d):
    """Label frequencies and class prior."""
    v = _li(spark, d)
    return E.class_counts(v.df, "target").withColumn("share", _r("share"))


_OH_COLS = ["price_b", "priority"]


@register("onehot_slots", f"WITH {O.view_cte('ord')} SELECT row_key, 'price_b' AS col_name, price_b AS slot FROM ord "
          f"UNION ALL SELECT row_key, 'priority' AS col_name, priority + 5 AS slot FROM ord")
def q_onehot_slots(spark, d):
    """P10 (long form): active one-hot slot per row and column over fixed category lists."""
    v = model_view(spark, d, "ord")
    enc = E.CategoryEncoder.fit(v.df, _OH_COLS)
    return E.onehot_long(v.df, "row_key", _OH_COLS, enc).withColumnRenamed("column", "col_name")


@register("category_union", f"WITH {O.view_cte('li')}, {O.split_cte('li')} SELECT DISTINCT col_name, value FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM split" for c in O.LI_NODES) + ")")
def q_category_union(spark, d):
    """Union of the categories of two tables (train and test split) per column."""
    v, sp = _li_split(spark, d)
    a, b = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    return E.category_union(a, b, v.nodes).withColumnRenamed("column", "col_name")


# ------------------------------------------------------------------ C: counts and information

@register("cross_table", f"WITH {O.view_cte('li')} SELECT qty_b, target, count(*) * 1e0 AS n FROM li GROUP BY qty_b, target")
def q_cross_table(spark, d):
    """Two-way counts."""
    v = _li(spark, d)
    return C.cross_table(v.df, ["qty_b", "target"]).withColumn("n", F.col("n").cast("double"))


_PAIRS = [(a, b) for i, a in enumerate(O.LI_NODES) for b in O.LI_NODES[i + 1:]]


@register("multi_cross_table", f"WITH {O.view_cte('li')} " + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS family, {a} AS x, {b} AS y, count(*) * 1e0 AS n FROM li GROUP BY {a}, {b}" for a, b in _PAIRS))
def q_multi_cross_table(spark, d):
    """All 15 pair tables of the view in one scan."""
    v = _li(spark, d)
    ct = C.family_counts(v.df, [(a, (b,)) for a, b in _PAIRS])
    names = spark.createDataFrame([(i, f"{a}|{b}") for i, (a, b) in enumerate(_PAIRS)], "fam int, family string")
    return ct.join(F.broadcast(names), "fam").select("family", "x", F.get(F.col("pa"), 0).alias("y"), "n")


@register("normalize_by_column", f"WITH {O.view_cte('li')} SELECT family, x, y, round(n / sum(n) OVER (PARTITION BY family, y), 6) AS p FROM ("
          + " UNION ALL ".join(f"SELECT '{f}' AS family, {f} AS x, target AS y, count(*) * 1e0 AS n FROM li GROUP BY {f}, target"
                               for f in O.LI_FEATURES) + ")")
def q_normalize(spark, d):
    """P(x | y) = n / Σ n over the parent configuration."""
    v = _li(spark, d)
    ct = C.family_counts(v.df, [(f, ("target",)) for f in v.features])
    names = spark.createDataFrame([(i, f) for i, f in enumerate(v.features)], "fam int, family string")
    p = C.normalize_by_parents(ct)
    return p.join(F.broadcast(names), "fam").select("family", "x", F.get(F.col("pa"), 0).alias("y"), _r("p").alias("p"))


_SB = ("qty_b", ("disc_b", "tax_b"))


@register("smooth_backoff",
          f"WITH {O.view_cte('li')}, dom AS (SELECT * FROM range(5) a(qty_b), range(5) b(disc_b), range(5) c(tax_b)), "
          "l2 AS (SELECT qty_b, disc_b, tax_b, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY disc_b, tax_b) AS p2 FROM li GROUP BY qty_b, disc_b, tax_b), "
          "l1 AS (SELECT qty_b, disc_b, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY disc_b) AS p1 FROM li GROUP BY qty_b, disc_b), "
          "l0 AS (SELECT qty_b, count(*) * 1e0 / sum(count(*)) OVER () AS p0 FROM li GROUP BY qty_b) "
          "SELECT dom.qty_b, dom.disc_b, dom.tax_b, round(coalesce(CASE WHEN p2 > 0 THEN p2 END, CASE WHEN p1 > 0 THEN p1 END, coalesce(p0, 0.0)), 6) AS p "
          "FROM dom LEFT JOIN l2 USING (qty_b, disc_b, tax_b) LEFT JOIN l1 USING (qty_b, disc_b) LEFT JOIN l0 USING (qty_b)")
def q_smooth_backoff(spark, d):
    """C4: zero cells back off to the estimate with the last parent summed out."""
    v = _li(spark, d)
    out = C.smooth_backoff(v.df, _SB[0], list(_SB[1]), v.cards())
    return out.select("qty_b", "disc_b", "tax_b", _r("p").alias("p"))


@register("add_uniform",
          f"WITH {O.view_cte('li')}, dom AS (SELECT * FROM range(5) a(qty_b), range(5) b(price_b), range(2) c(status)), "
          "ct AS (SELECT qty_b, price_b, status, count(*) * 1e0 AS n FROM li GROUP BY qty_b, price_b, status), "
          "dn AS (SELECT dom.*, coalesce(n, 0.0) AS n FROM dom LEFT JOIN ct USING (qty_b, price_b, status)), "
          "nz AS (SELECT *, n + CASE WHEN n = 0 THEN 1e-5 ELSE 0.0 END AS nn, sum(n) OVER (PARTITION BY price_b, status) AS cs, "
          "count(*) OVER (PARTITION BY price_b, status) AS k FROM dn) "
          "SELECT qty_b, price_b, status, round(CASE WHEN cs = 0 THEN 1.0 / k ELSE nn / sum(nn) OVER (PARTITION BY price_b, status) END, 9) AS p FROM nz")
def q_add_uniform(spark, d):
    """Dense CPT, noise on zero cells, uniform for empty parent configurations."""
    v = _li(spark, d)
    cards = v.cards()
    dom = C.dense_domain(spark, ["qty_b", "price_b", "status"], cards)
    ct = C.cross_table(v.df, ["qty_b", "price_b", "status"])
    dense = dom.join(ct, ["qty_b", "price_b", "status"], "left")
    out = C.add_uniform(dense, "qty_b", ["price_b", "status"], noise=1e-5)
    return out.select("qty_b", "price_b", "status", _r("p", 9).alias("p"))


@register("mutual_info", f"WITH {O.view_cte('li')} SELECT feature, round(mi, 8) AS mi FROM ({O.mi_sql('li', O.LI_FEATURES, 'target')})")
def q_mutual_info(spark, d):
    """I(X;Y) in bits per feature."""
    v = _li(spark, d)
    return C.mutual_info(v.df, v.features, v.label).select("feature", _r("mi", 8).alias("mi"))


@register("cond_mutual_info", f"WITH {O.view_cte('li')} SELECT a, b, round(cmi, 8) AS cmi FROM ({O.cmi_sql('li', O.LI_FEATURES, 'target')})")
def q_cond_mutual_info(spark, d):
    """I(Xi;Xj | Y) in bits per pair."""
    v = _li(spark, d)
    pairs = [(a, b) for i, a in enumerate(v.features) for b in v.features[i + 1:]]
    return C.cond_mutual_info(v.df, pairs, v.label).select("a", "b", _r("cmi", 8).alias("cmi"))


@register("rank_features", f"WITH {O.view_cte('li')}, mi AS ({O.mi_sql('li', O.LI_FEATURES, 'target')}), ix AS ({O.idx_sql(O.LI_FEATURES)}) "
          "SELECT feature, CAST(row_number() OVER (ORDER BY round(mi, 10) DESC, idx) - 1 AS INTEGER) AS rank FROM mi JOIN ix USING (feature)")
def q_rank_features(spark, d):
    """Features by MI descending, ties by position."""
    v = _li(spark, d)
    return C.rank_features(C.mutual_info(v.df, v.features, v.label), v.features).select("feature", "rank")


@register("entropy", f"WITH {O.view_cte('li')} SELECT round(-sum(p * ln(p)) / ln(2.0), 8) AS entropy FROM "
          "(SELECT count(*) * 1e0 / (SELECT count(*) FROM li) AS p FROM li GROUP BY qty_b, target)")
def q_entropy(spark, d):
    """Joint entropy in bits."""
    v = _li(spark, d)
    return C.entropy(v.df, ["qty_b", "target"]).select(_r("entropy", 8).alias("entropy"))


@register("jsd_train_test",
          f"WITH {O.view_cte('li')}, {O.split_cte('li')}, "
          "lv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value, is_test FROM split" for c in O.LI_NODES) + "), "
          "h AS (SELECT col_name, value, is_test, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY col_name, is_test) AS s FROM lv GROUP BY col_name, value, is_test), "
          "j AS (SELECT coalesce(a.col_name, b.col_name) AS col_name, coalesce(a.s, 0.0) AS p, coalesce(b.s, 0.0) AS q FROM "
          "(SELECT * FROM h WHERE NOT is_test) a FULL OUTER JOIN (SELECT * FROM h WHERE is_test) b ON a.col_name = b.col_name AND a.value = b.value) "
          "SELECT col_name, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 / ln(2.0), 8) AS jsd "
          "FROM j GROUP BY col_name")
def q_jsd(spark, d):
    """Jensen–Shannon divergence per column between the train and test rows."""
    v, sp = _li_split(spark, d)
    out = C.jsd(sp.filter(~F.col("is_test")), sp.filter(F.col("is_test")), v.nodes)
    return out.select(F.col("column").alias("col_name"), _r("jsd", 8).alias("jsd"))


@register("wasserstein_train_test",
          f"WITH {O.view_cte('li')}, {O.split_cte('li')}, "
          "raw AS (SELECT " + LI_KEY + " AS row_key, " + ", ".join(LI_DOUBLES) + " FROM lineitem), "
          "rs AS (SELECT raw.*, is_test FROM raw JOIN split USING (row_key)), "
          "lv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS DOUBLE) AS value, is_test FROM rs" for c in LI_DOUBLES) + "), "
          "h AS (SELECT col_name, value, sum(CASE WHEN NOT is_test THEN 1 ELSE 0 END) * 1e0 AS a, sum(CASE WHEN is_test THEN 1 ELSE 0 END) * 1e0 AS b FROM lv GROUP BY col_name, value), "
          "hn AS (SELECT col_name, value, a / sum(a) OVER (PARTITION BY col_name) AS a, b / sum(b) OVER (PARTITION BY col_name) AS b FROM h), "
          "c AS (SELECT col_name, value, sum(a) OVER w AS fa, sum(b) OVER w AS fb, lead(value) OVER (PARTITION BY col_name ORDER BY value) AS nx FROM hn "
          "WINDOW w AS (PARTITION BY col_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
          "SELECT col_name, round(sum(abs(fa - fb) * coalesce(nx - value, 0.0)), 6) AS w1 FROM c GROUP BY col_name")
def q_wasserstein(spark, d):
    """1-D Wasserstein distance per raw column between the train and test rows."""
    v, sp = _li_split(spark, d)
    raw = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *LI_DOUBLES)
    rs = raw.join(sp.select("row_key", "is_test"), "row_key")
    out = C.wasserstein1(rs.filter(~F.col("is_test")), rs.filter(F.col("is_test")), LI_DOUBLES)
    return out.select(F.col("column").alias("col_name"), _r("w1").alias("w1"))


# ------------------------------------------------------------------ K: structure and scores

_FEATS = O.LI_FEATURES
_NAIVE = [("target", f) for f in _FEATS]


@register("kdb_edges", f"WITH {O.view_cte('li')} {O.kdb_sql('li', _FEATS, 'target', 2)}".replace(
    f"WITH {O.view_cte('li')} WITH ", f"WITH {O.view_cte('li')}, "))
def q_kdb_edges(spark, d):
    """K1: k-dependence structure (k = 2) from MI ranks and CMI."""
    v = _li(spark, d)
    return K.edges_df(spark, K.kdb_structure(v.df, v.features, v.label, 2))


@register("kdb_parents", (f"WITH {O.view_cte('li')}, e AS ({O.kdb_sql('li', _FEATS, 'target', 2)}), ix AS ({O.idx_sql(_FEATS)}) "
                          "SELECT dst AS child, coalesce(string_agg(src, ',' ORDER BY idx), '') AS parents FROM "
                          "(SELECT e.dst, CASE WHEN e.src = 'target' THEN NULL ELSE e.src END AS src, ix.idx FROM e LEFT JOIN ix ON ix.feature = e.src) "
                          "GROUP BY dst").replace("e AS (WITH ", "e AS (WITH "))
def q_kdb_parents(spark, d):
    """K2: feature parents of each feature (label removed), ordered by feature position."""
    v = _li(spark, d)
    ps = K.parents_without_label(K.kdb_structure(v.df, v.features, v.label, 2), v.label, v.features)
    return spark.createDataFrame([(c, ",".join(p)) for c, p in ps.items()], "child string, parents string")


_HO = {"qty_b": ("disc_b", "tax_b"), "price_b": ("qty_b",), "status": ()}


@register("high_order_codes", f"WITH {O.view_cte('li')}, c AS (SELECT row_key, "
          "disc_b * 25 + tax_b * 5 + qty_b AS qty_b, qty_b * 5 + price_b AS price_b, status FROM li) "
          "SELECT row_key, CAST(dense_rank() OVER (ORDER BY qty_b) - 1 AS INTEGER) AS qty_b_ho, "
          "CAST(dense_rank() OVER (ORDER BY price_b) - 1 AS INTEGER) AS price_b_ho, "
          "CAST(dense_rank() OVER (ORDER BY status) - 1 AS INTEGER) AS status_ho FROM c")
def q_high_order_codes(spark, d):
    """K3: mixed-radix code of (child, parents), compressed to the observed combinations."""
    v = _li(spark, d)
    feats = list(_HO)
    edges = [(p, c) for c, ps in _HO.items() for p in ps] + [(v.label, c) for c in feats]
    enc = K.HighOrderEncoder.fit(v.df, feats, v.label, v.cards(), edges=edges)
    return enc.transform(v.df).select("row_key", "qty_b_ho", "price_b_ho", "status_ho")


@register("high_order_constraints", f"WITH {O.view_cte('li')} SELECT disc_b, tax_b, count(DISTINCT qty_b) AS n_child_values FROM li GROUP BY disc_b, tax_b")
def q_high_order_constraints(spark, d):
    """K4: number of child values seen under each observed parent configuration."""
    v = _li(spark, d)
    return K.high_order_constraints(v.df, "qty_b", ["disc_b", "tax_b"])


_LS_FAMS = [("target", ())] + [(f, ("target",)) for f in _FEATS] + [(f, ("target", g)) for f in _FEATS for g in _FEATS if g != f]


def _fam_name(child, pa):
    return child + "|" + ",".join(pa)


@register("local_scores", f"WITH {O.view_cte('li')} SELECT family, " + ", ".join(
    f"round({k}, 4) AS {k}" for k in ("ll", "bic", "aic", "k2", "bdeu", "bds")) + f" FROM {O.family_terms_sql('li', _LS_FAMS, O.li_cards_sql())}")
def q_local_scores(spark, d):
    """K7: LL, BIC, AIC, K2, BDeu and BDs of 26 families in one family-count job."""
    v = _li(spark, d)
    sc = S.local_scores(v.df, _LS_FAMS, v.cards(), "all")
    names = spark.createDataFrame([(i, _fam_name(c, p)) for i, (c, p) in enumerate(_LS_FAMS)], "fam int, family string")
    return sc.join(F.broadcast(names), "fam").select("family", *[_r(k, 4).alias(k) for k in ("ll", "bic", "aic", "k2", "bdeu", "bds")])


_NAIVE_FAMS = [("target", ())] + [(f, ("target",)) for f in _FEATS]


def _bicg_sql() -> str:
    n = "(SELECT count(*) * 1e0 FROM li)"
    parts = [f"SELECT 'target' AS node, var_pop(target * 1e0) AS v, 0 AS k FROM li"]
    for f in _FEATS:
        parts.append(f"SELECT '{f}', var_pop({f} * 1e0) - covar_pop({f} * 1e0, target * 1e0) * covar_pop({f} * 1e0, target * 1e0) / var_pop(target * 1e0), 1 FROM li")
    return (f"SELECT 'bic-g' AS kind, round(sum(-{n} / 2 * (ln(2 * pi() * v) + 1) - (k + 2) / 2.0 * ln({n})), 3) AS score "
            f"FROM ({' UNION ALL '.join(parts)})")


@register("structure_score", f"WITH {O.view_cte('li')}, t AS {O.family_terms_sql('li', _NAIVE_FAMS, O.li_cards_sql())} "
          + " UNION ALL ".join(f"SELECT '{k}' AS kind, round(sum({k}), 3) AS score FROM t" for k in ("ll", "bic", "aic", "k2", "bdeu", "bds"))
          + " UNION ALL " + _bicg_sql())
def q_structure_score(spark, d):
    """K9: Σ local scores of the naive structure, six discrete scores and the Gaussian BIC."""
    v = _li(spark, d)
    sc = S.local_scores(v.df, _NAIVE_FAMS, v.cards(), "all")
    kinds = ("ll", "bic", "aic", "k2", "bdeu", "bds")
    tot = sc.agg(*[F.sum(k).alias(k) for k in kinds])
    stack = ", ".join(f"'{k}', `{k}`" for k in kinds)
    disc = tot.select(F.expr(f"stack({len(kinds)}, {stack}) as (kind, score)"))
    g = S.structure_score(v.df, _NAIVE, v.nodes, v.cards(), "bic-g")
    gauss = spark.createDataFrame([("bic-g", float(g))], "kind string, score double")
    return disc.unionByName(gauss).select("kind", _r("score", 3).alias("score"))


def _delta_sql() -> str:
    fams = [("target", ())] + [(f, ()) for f in _FEATS] + [(f, ("target",)) for f in _FEATS] + [("target", (f,)) for f in _FEATS] \
        + [(y, ("target", x)) for y in _FEATS for x in _FEATS if x != y]
    adds = " UNION ALL ".join(
        f"SELECT '+|{x}|{y}' AS op, (SELECT bic FROM t WHERE family = '{y}|target,{x}') - (SELECT bic FROM t WHERE family = '{y}|target') AS delta"
        for x in _FEATS for y in _FEATS if x != y)
    flips = " UNION ALL ".join(
        f"SELECT 'flip|target|{x}' AS op, (SELECT bic FROM t WHERE family = 'target|{x}') + (SELECT bic FROM t WHERE family = '{x}|') "
        f"- (SELECT bic FROM t WHERE family = 'target|') - (SELECT bic FROM t WHERE family = '{x}|target') AS delta" for x in _FEATS)
    return f"WITH {O.view_cte('li')}, t AS {O.family_terms_sql('li', fams, O.li_cards_sql())}, ops AS ({adds} UNION ALL {flips})"


def _naive_cache(spark, d):
    v = _li(spark, d)
    # family keys use node order: features then label, so the label sorts last
    return v, K.FamilyScoreCache(v.df, v.nodes, v.cards(), "bic")


def _op_text(op):
    return f"{op[0]}|{op[1][0]}|{op[1][1]}"


@register("score_neighbours", _delta_sql() + " SELECT op, round(delta, 4) + 0.0 AS delta FROM ops")
def q_score_neighbours(spark, d):
    """K10 + K11: every legal move from the naive structure with its BIC Δ (one scoring job)."""
    v, cache = _naive_cache(spark, d)
    ops = K.neighbours(_NAIVE, v.nodes)
    rows = [(_op_text(op), float(delta)) for op, delta in K.score_neighbours(cache, _NAIVE, ops)]
    return spark.createDataFrame(rows, "op string, delta double").select("op", (_r("delta", 4) + F.lit(0.0)).alias("delta"))


@register("hill_climb_step", _delta_sql() + " SELECT CASE WHEN delta >= 1e-4 THEN op ELSE 'none' END AS op, round(delta, 4) AS delta "
          "FROM ops ORDER BY round(delta, 9) DESC, op LIMIT 1")
def q_hill_climb_step(spark, d):
    """The best move by Δ (ties by op text), 'none' below ε = 1e-4."""
    v, cache = _naive_cache(spark, d)
    op, delta = K.hill_climb_step(cache, _NAIVE, [])
    return spark.createDataFrame([(_op_text(op) if op else "none", float(delta))], "op string, delta double").select(
        "op", _r("delta", 4).alias("delta"))


@register("hill_climb")
def q_hill_climb(spark, d):
    """Hill climbing to a local optimum from the naive structure (edges)."""
    v, cache = _naive_cache(spark, d)
    return K.edges_df(spark, K.hill_climb(v.df, v.nodes, v.cards(), "bic", start=_NAIVE, cache=cache))


@register("hill_climb_customers", search_sql.hill_climb(["nation", "region", "target"]))
def q_hill_climb_customers(spark, d):
    """K14 on columns with dependence: nation decides region; from the empty graph to a local optimum."""
    v, nodes = model_view(spark, d, "cust"), ["nation", "region", "target"]
    return K.edges_df(spark, K.hill_climb(v.df, nodes, v.cards(), "bic"))


@register("hill_climb_k2")
def q_hill_climb_k2(spark, d):
    """K14 with the K2 score from the empty graph, at most 2 parents per node."""
    v = _li(spark, d)
    return K.edges_df(spark, K.hill_climb(v.df, v.nodes, v.cards(), "k2", max_indegree=2))


@register("tree_search")
def q_tree_search(spark, d):
    """Chow–Liu tree over all columns of the view, rooted at the largest MI sum."""
    v = _li(spark, d)
    return K.edges_df(spark, K.tree_search(v.df, v.nodes))


@register("mi_ordered_candidates", f"WITH {O.view_cte('li')}, mi AS ({O.mi_sql('li', _FEATS, 'target')}), ix AS ({O.idx_sql(_FEATS)}), "
          "rk AS (SELECT feature, row_number() OVER (ORDER BY round(mi, 10) DESC, idx) - 1 AS r FROM mi JOIN ix USING (feature)) "
          "SELECT a.feature AS src, b.feature AS dst FROM rk a JOIN rk b ON a.r > b.r")
def q_mi_candidates(spark, d):
    """Candidate edges from lower-MI to higher-MI features, minus existing edges."""
    v = _li(spark, d)
    mi, _ = K.mi_cmi(v.df, v.features, v.label)
    order = K.mi_order(mi, v.features)
    return K.edges_df(spark, K.mi_ordered_candidates(_NAIVE, order))


@register("state_key", f"WITH {O.view_cte('li')}, e AS ({O.kdb_sql('li', _FEATS, 'target', 2)}) "
          "SELECT sha256(string_agg(src || '>' || dst, ';' ORDER BY src || '>' || dst)) AS state_key FROM e")
def q_state_key(spark, d):
    """Set-equality key of the kDB structure."""
    v = _li(spark, d)
    return K.state_key_df(K.edges_df(spark, K.kdb_structure(v.df, v.features, v.label, 2)))


# ------------------------------------------------------------------ G: parameters, generation, inference

def _naive_cpts(spark, d):
    v = _li(spark, d)
    return v, fit_cpts(v.df, _NAIVE, v.nodes)


def _naive_cpt_sql_rows() -> str:
    parts = [f"SELECT 'target' AS child, '' AS pa, CAST(value AS INTEGER) AS value, round(n / sum(n) OVER (), 6) AS p, round(lo, 6) AS cum_lo, round(hi, 6) AS cum_hi FROM cpt_target"]
    for f in _FEATS:
        parts.append(f"SELECT '{f}', CAST(p0 AS VARCHAR), CAST(value AS INTEGER), round(n / sum(n) OVER (PARTITION BY p0), 6), round(lo, 6), round(hi, 6) FROM cpt_{f}")
    return " UNION ALL ".join(parts)


@register("fit_cpts", f"WITH {O.view_cte('li')}, {O.naive_cpt_ctes('li', _FEATS, 'target')} {_naive_cpt_sql_rows()}")
def q_fit_cpts(spark, d):
    """G1: maximum-likelihood CPTs of the naive structure with sampling intervals."""
    v, cp = _naive_cpts(spark, d)
    return cp.select("child", F.array_join(F.col("pa").cast("array<string>"), ",").alias("pa"), "value",
                     _r("p").alias("p"), _r("cum_lo").alias("cum_lo"), _r("cum_hi").alias("cum_hi"))


@register("cpt_check", f"WITH {O.view_cte('li')} SELECT 'target' AS child, 1 AS n_configs, 0 AS n_bad UNION ALL " + " UNION ALL ".join(
    f"SELECT '{f}', count(DISTINCT target), 0 FROM li" for f in _FEATS))
def q_cpt_check(spark, d):
    """Every configuration of every fitted CPT sums to 1 (n_bad = 0)."""
    v, cp = _naive_cpts(spark, d)
    return cpt_check_summary(cp).select("child", F.col("n_configs").cast("int").alias("n_configs"), F.col("n_bad").cast("int").alias("n_bad"))


def _odd_cpts(spark, d):
    """The naive CPTs with every probability but a value's 0 raised by its code."""
    v, cp = _naive_cpts(spark, d)
    return cp.withColumn("p", F.col("p") * (1 + F.col("value")))


@register("cpt_fix", f"WITH {O.view_cte('li')}, {O.naive_cpt_ctes('li', _FEATS, 'target')}, rw AS (SELECT 'target' AS child, '' AS pa, value, n FROM cpt_target "
          + "".join(f"UNION ALL SELECT '{f}', p0::VARCHAR, value, n FROM cpt_{f} " for f in _FEATS) + ") "
          "SELECT child, pa, value, round(n * (1 + value) / sum(n * (1 + value)) OVER (PARTITION BY child, pa), 9) AS p FROM rw")
def q_cpt_fix(spark, d):
    """Configurations that don't sum to 1 are scaled to do so."""
    from bayesloom.operators.cpt import cpt_fix
    return cpt_fix(_odd_cpts(spark, d)).select("child", F.concat_ws(",", F.transform("pa", lambda x: x.cast("string"))).alias("pa"), "value", _r("p", 9).alias("p"))


@register("cpt_check_odd", f"WITH {O.view_cte('li')} SELECT 'target' AS child, 1 AS n_configs, 1 AS n_bad UNION ALL " + " UNION ALL ".join(
    f"SELECT '{f}', count(*), sum(m) FROM (SELECT target, (max({f}) > 0)::INTEGER AS m FROM li GROUP BY target)" for f in _FEATS))
def q_cpt_check_odd(spark, d):
    """The configurations of the raised tables are found (those with a value above 0)."""
    out = cpt_check_summary(_odd_cpts(spark, d))
    return out.select("child", F.col("n_configs").cast("int").alias("n_configs"), F.col("n_bad").cast("int").alias("n_bad"))


@register("refresh_cpts", f"WITH {O.view_cte('li')}, {O.naive_cpt_ctes('li', _FEATS, 'target')} SELECT 'target' AS child, '' AS pa, value, round(n / sum(n) OVER (), 9) AS p FROM cpt_target "
          + "".join(f"UNION ALL SELECT '{f}', p0::VARCHAR, value, round(n / sum(n) OVER (PARTITION BY p0), 9) FROM cpt_{f} " for f in _FEATS if f != "disc_b")
          + "UNION ALL SELECT 'disc_b', price_b || ',' || target, disc_b, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY price_b, target), 9) FROM li GROUP BY price_b, target, disc_b")
def q_refresh_cpts(spark, d):
    """After one more edge only that family is fitted again."""
    from bayesloom.operators.cpt import refresh_cpts
    v, cp = _naive_cpts(spark, d)
    out = refresh_cpts(cp, v.df, _NAIVE, [*_NAIVE, ("price_b", "disc_b")], v.nodes)
    return out.select("child", F.concat_ws(",", F.transform("pa", lambda x: x.cast("string"))).alias("pa"), "value", _r("p", 9).alias("p"))


@register("preprocess_split", f"WITH {O.view_cte('li')}, {O.split_cte('li')} SELECT row_key, qty_b AS l_quantity, price_b AS l_extendedprice, disc_b AS l_discount, "
          "tax_b AS l_tax, status AS l_linestatus, target AS l_returnflag, is_test FROM split")
def q_preprocess_split(spark, d):
    """P6 (P5 + P1 + P7 in one call): raw line items to coded train and test rows."""
    from bayesloom.operators.discretise import Preprocessor
    raw = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *LI_DOUBLES, "l_linestatus", "l_returnflag")
    _, train, test = Preprocessor.split(raw, "l_returnflag")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


_SAMPLE_SQL = f"WITH {O.view_cte('li')}, {O.naive_sample_ctes('li', _FEATS, 'target')}"


@register("ancestral_sample", _SAMPLE_SQL + " SELECT * FROM sample")
def q_ancestral_sample(spark, d):
    """N synthetic rows from the naive structure (hash uniforms, broadcast CPT joins)."""
    v, cp = _naive_cpts(spark, d)
    n = v.df.count()
    return ancestral_sample(spark, cp, _NAIVE, v.nodes, v.cards(), n, seed=42)


@register("sample_decoded", _SAMPLE_SQL + ", ds AS (SELECT DISTINCT l_linestatus AS v FROM lineitem), "
          "dt AS (SELECT DISTINCT l_returnflag AS v FROM lineitem), "
          "ds2 AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM ds), "
          "dt2 AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM dt) "
          "SELECT row_id, qty_b, price_b, disc_b, tax_b, ds2.v AS l_linestatus, dt2.v AS l_returnflag FROM sample "
          "JOIN ds2 ON ds2.code = sample.status JOIN dt2 ON dt2.code = sample.target")
def q_sample_decoded(spark, d):
    """Synthetic rows decoded back to the original category values."""
    v, cp = _naive_cpts(spark, d)
    s = ancestral_sample(spark, cp, _NAIVE, v.nodes, v.cards(), v.df.count(), seed=42)
    s = s.withColumnRenamed("status", "l_linestatus").withColumnRenamed("target", "l_returnflag")
    return v.encoder.inverse(s)


def _gnb_sql_params(src: str, feats=None) -> str:
    """CTE gnb(y, f, mean, var, lp) from ``src``; var smoothed by 1e-9 · max overall variance."""
    feats = feats or _FEATS
    eps = "(1e-9 * greatest(" + ", ".join(f"(SELECT var_pop({f} * 1e0) FROM {src})" for f in feats) + ", 0.0))"
    parts = " UNION ALL ".join(
        f"SELECT target AS y, '{f}' AS f, avg({f} * 1e0) AS mean, var_pop({f} * 1e0) + {eps} AS var FROM {src} GROUP BY target" for f in feats)
    return (f"gnb AS ({parts}), gnb_prior AS (SELECT target AS y, count(*) AS n, ln(count(*) * 1e0 / (SELECT count(*) FROM {src})) AS lp "
            f"FROM {src} GROUP BY target)")


@register("gaussian_nb_fit", f"WITH {O.view_cte('li')}, {_gnb_sql_params('li')} SELECT y AS target, f AS feature, round(mean, 6) AS mean, round(var, 6) AS var FROM gnb")
def q_gnb_fit(spark, d):
    """Per class mean and smoothed variance of each feature."""
    v = _li(spark, d)
    m = GaussianNB.fit(v.df, v.features, v.label)
    rows = [(c, f, m.mean[c][f], m.var[c][f]) for c in m.classes for f in m.features]
    return spark.createDataFrame(rows, "target int, feature string, mean double, var double").select(
        "target", "feature", _r("mean").alias("mean"), _r("var").alias("var"))


def _gnb_sample_sql() -> str:
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cols = []
    for i, f in enumerate(_FEATS):
        u = O.ub_sql("s.row_id", i)
        cols.append(f"round((SELECT mean FROM gnb WHERE gnb.y = s.target AND gnb.f = '{f}') + "
                    f"sqrt((SELECT var FROM gnb WHERE gnb.y = s.target AND gnb.f = '{f}')) * {O.probit('(' + u + ')')}, 6) AS {f}")
    ut = O.ub_sql("s0.row_id", len(_FEATS))
    return (f"WITH {O.view_cte('li')}, {_gnb_sql_params('li')}, "
            f"cum AS (SELECT y, (sum(n) OVER (ORDER BY y {run}) - n) * 1e0 / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY y {run}) * 1e0 / sum(n) OVER () AS hi FROM gnb_prior), "
            f"s0 AS (SELECT row_number() OVER () - 1 AS row_id FROM li), "
            f"s AS (SELECT s0.row_id, cum.y AS target FROM s0 JOIN cum ON {ut} >= cum.lo AND {ut} < cum.hi) "
            f"SELECT row_id, target, {', '.join(cols)} FROM s")


@register("gaussian_nb_sample", _gnb_sample_sql())
def q_gnb_sample(spark, d):
    """N rows from the Gaussian naive Bayes generator (Φ⁻¹ of hash uniforms)."""
    v = _li(spark, d)
    m = GaussianNB.fit(v.df, v.features, v.label)
    s = gaussian_nb_sample(spark, m, v.df.count(), seed=42)
    return s.select("row_id", "target", *[_r(f).alias(f) for f in v.features])


def _split_tables():
    return f"WITH {O.view_cte('li')}, {O.split_cte('li')}, tr AS (SELECT * FROM split WHERE NOT is_test), te AS (SELECT * FROM split WHERE is_test)"


def _gnb_predict_sql(out: str = "gp", feats=None) -> str:
    feats = feats or _FEATS
    tl = " UNION ALL ".join(f"SELECT row_key, '{f}' AS f, {f} * 1e0 AS x FROM te" for f in feats)
    return (f"{_gnb_sql_params('tr', feats)}, tl AS ({tl}), "
            f"jl AS (SELECT tl.row_key, g.y, round(any_value(p.lp) + sum(-0.5 * ln(2 * pi() * g.var) - (tl.x - g.mean) * (tl.x - g.mean) / (2 * g.var)), 9) AS s "
            f"FROM tl JOIN gnb g ON g.f = tl.f JOIN gnb_prior p ON p.y = g.y GROUP BY tl.row_key, g.y), "
            f"{out} AS (SELECT row_key, CAST(y AS INTEGER) AS pred FROM (SELECT row_key, y, row_number() OVER (PARTITION BY row_key ORDER BY s DESC, y) AS rn FROM jl) WHERE rn = 1)")


@register("gaussian_nb_predict", f"{_split_tables()}, {_gnb_predict_sql()} SELECT * FROM gp")
def q_gnb_predict(spark, d):
    """Gaussian NB fitted on the train rows, argmax posterior on the test rows."""
    v, sp = _li_split(spark, d)
    m = GaussianNB.fit(sp.filter(~F.col("is_test")), v.features, v.label)
    return m.predict(sp.filter(F.col("is_test")), "pred").select("row_key", F.col("pred").cast("int").alias("pred"))


def _map_pred(spark, d):
    v, sp = _li_split(spark, d)
    tr = sp.filter(~F.col("is_test"))
    cp = fit_cpts(tr, _NAIVE, v.nodes)
    return v, bn_map_predict(sp.filter(F.col("is_test")), cp, _NAIVE, v.nodes, v.label, v.cards(), "pred")


@register("bn_map_predict", f"{_split_tables()}, {O.naive_map_ctes('tr', 'te', _FEATS, 'target')} SELECT * FROM pred")
def q_bn_map_predict(spark, d):
    """MAP label of each test row under the naive BN fitted on the train rows."""
    _, p = _map_pred(spark, d)
    return p.select("row_key", "pred")


@register("accuracy", f"{_split_tables()}, {O.naive_map_ctes('tr', 'te', _FEATS, 'target')} "
          "SELECT round(coalesce(avg(CASE WHEN p.pred = te.target THEN 1.0 ELSE 0.0 END), 0.0), 6) AS accuracy, count(*) AS n_predicted "
          "FROM pred p JOIN te USING (row_key) WHERE p.pred IS NOT NULL")
def q_accuracy(spark, d):
    """V9: share of correct predictions among predicted test rows (0.0 when none)."""
    from bayesloom.operators.evaluate import accuracy
    _, p = _map_pred(spark, d)
    return accuracy(p, "pred", "target").withColumn("accuracy", _r("accuracy"))


@register("gaussian_nb_bic", f"WITH {O.view_cte('li')}, {_gnb_sql_params('li')}, "
          "tl AS (" + " UNION ALL ".join(f"SELECT row_key, target, '{f}' AS f, {f} * 1e0 AS x FROM li" for f in _FEATS) + "), "
          "jl AS (SELECT tl.row_key, any_value(tl.target) AS t, g.y, any_value(p.lp) + sum(-0.5 * ln(2 * pi() * g.var) - (tl.x - g.mean) * (tl.x - g.mean) / (2 * g.var)) AS s "
          "FROM tl JOIN gnb g ON g.f = tl.f JOIN gnb_prior p ON p.y = g.y GROUP BY tl.row_key, g.y), "
          "pm AS (SELECT row_key, max(CASE WHEN y = t THEN s END) AS st, max(s) AS m FROM jl GROUP BY row_key), "
          "post AS (SELECT jl.row_key, any_value(pm.st) - any_value(pm.m) - ln(sum(exp(jl.s - pm.m))) AS lpost FROM jl JOIN pm USING (row_key) GROUP BY jl.row_key) "
          f"SELECT round(-2 * sum(lpost) + ((SELECT count(*) FROM gnb_prior) * 2 * {len(_FEATS)} + (SELECT count(*) FROM gnb_prior) - 1) * ln((SELECT count(*) FROM li) * 1e0), 3) AS bic FROM post")
def q_gnb_bic(spark, d):
    """−2·Σ ln P(true class | x) + (C·2d + C − 1)·ln N of a Gaussian NB on its training table."""
    from bayesloom.operators.evaluate import gaussian_nb_bic
    v = _li(spark, d)
    m = GaussianNB.fit(v.df, v.features, v.label)
    return gaussian_nb_bic(m, v.df).select(_r("bic", 3).alias("bic"))


@register("union_labelled", _SAMPLE_SQL + " SELECT qty_b, price_b, disc_b, tax_b, status, target, 1 AS is_real FROM li "
          "UNION ALL SELECT qty_b, price_b, disc_b, tax_b, status, target, 0 AS is_real FROM sample")
def q_union_labelled(spark, d):
    """Real rows (1) stacked on synthetic rows (0)."""
    v, cp = _naive_cpts(spark, d)
    s = ancestral_sample(spark, cp, _NAIVE, v.nodes, v.cards(), v.df.count(), seed=42)
    return union_labelled(v.df.select(*v.nodes), s.select(*v.nodes))


# ------------------------------------------------------------------ R: train-on-real results and reports

_VIEWS = {"li": _FEATS, "ord": ["price_b", "priority"]}


def _trtr_long(spark, d) -> DataFrame:
    """(dataset, model, metric, value): test accuracy of naive-BN MAP and Gaussian NB trained on the train split."""
    from bayesloom.operators.evaluate import accuracy
    rows = []
    for name, feats in _VIEWS.items():
        v = model_view(spark, d, name)
        sp = SEL.stratified_split(v.df, v.label, "row_key", 0.2, 42).persist()
        tr, te = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
        edges = K.naive_structure(feats, v.label)
        cp = fit_cpts(tr, edges, v.nodes)
        a1 = accuracy(bn_map_predict(te, cp, edges, v.nodes, v.label, v.cards(), "pred"), "pred", v.label).first()[0]
        g = GaussianNB.fit(tr, feats, v.label)
        a2 = accuracy(g.predict(te, "pred"), "pred", v.label).first()[0]
        rows += [(name, "nb_map", "accuracy", round(float(a1), 6)), (name, "gnb", "accuracy", round(float(a2), 6))]
        sp.unpersist()
    return spark.createDataFrame(rows, "dataset string, model string, metric string, value double")


def _trtr_sql_body() -> str:
    parts = []
    ctes = []
    for name, feats in _VIEWS.items():
        ctes.append(O.view_cte(name))
        u = O.u_sql("row_key", "split")
        ctes.append(f"{name}_sp AS (SELECT * EXCLUDE (rn, cnt), rn <= ceil(cnt * 0.2) AS is_test FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY target ORDER BY {u}, row_key) AS rn, count(*) OVER (PARTITION BY target) AS cnt FROM {name}))")
        ctes.append(f"{name}_tr AS (SELECT * FROM {name}_sp WHERE NOT is_test), {name}_te AS (SELECT * FROM {name}_sp WHERE is_test)")
        ctes.append(O.naive_map_ctes(f"{name}_tr", f"{name}_te", feats, "target", out=f"{name}_mp"))
        gsql = _gnb_predict_sql(f"{name}_gp", feats).replace("FROM te", f"FROM {name}_te").replace("'tr'", f"'{name}_tr'")
        gsql = gsql.replace("gnb AS (", f"{name}_gnb AS (").replace("gnb_prior", f"{name}_gnb_prior").replace("JOIN gnb g", f"JOIN {name}_gnb g")
        gsql = gsql.replace(" tl AS (", f" {name}_tl AS (").replace("FROM tl JOIN", f"FROM {name}_tl tl JOIN").replace("jl AS (", f"{name}_jl AS (").replace("FROM jl)", f"FROM {name}_jl)")
        gsql = gsql.replace("FROM tr", f"FROM {name}_tr")
        ctes.append(gsql)
        parts.append(f"SELECT '{name}' AS dataset, 'nb_map' AS model, 'accuracy' AS metric, round(coalesce(avg(CASE WHEN p.pred = t.target THEN 1.0 ELSE 0.0 END), 0.0), 6) AS value "
                     f"FROM {name}_mp p JOIN {name}_te t USING (row_key) WHERE p.pred IS NOT NULL")
        parts.append(f"SELECT '{name}', 'gnb', 'accuracy', round(coalesce(avg(CASE WHEN p.pred = t.target THEN 1.0 ELSE 0.0 END), 0.0), 6) "
                     f"FROM {name}_gp p JOIN {name}_te t USING (row_key) WHERE p.pred IS NOT NULL")
    return "WITH " + ", ".join(ctes) + ", res AS (" + " UNION ALL ".join(parts) + ")"


@register("trtr_results", _trtr_sql_body() + " SELECT * FROM res")
def q_trtr_results(spark, d):
    """V8 (discrete part) + V9: train-on-real test accuracies, long results table."""
    return _trtr_long(spark, d)


@register("format_results", _trtr_sql_body() + " SELECT dataset, max(CASE WHEN model = 'gnb' THEN value END) AS gnb, "
          "max(CASE WHEN model = 'nb_map' THEN value END) AS nb_map FROM res GROUP BY dataset")
def q_format_results(spark, d):
    """Dataset × model table of the accuracy."""
    from bayesloom.operators.report import format_results
    return format_results(_trtr_long(spark, d), "accuracy")


@register("average_classifiers", _trtr_sql_body() + " SELECT dataset, model, metric, value FROM res UNION ALL "
          "SELECT dataset, model, 'avg', round(avg(value), 6) FROM res GROUP BY dataset, model")
def q_average_classifiers(spark, d):
    """R2: AVG column per model over its classifier metrics (here one: accuracy)."""
    from bayesloom.operators.report import average_classifiers
    return average_classifiers(_trtr_long(spark, d), ("accuracy",)).withColumn("value", _r("value"))


@register("leaderboard", _trtr_sql_body() + " SELECT dataset, model, metric, value, CAST(rank() OVER (PARTITION BY dataset ORDER BY value DESC) AS INTEGER) AS rank FROM res")
def q_leaderboard(spark, d):
    """Models ranked per dataset."""
    from bayesloom.operators.report import leaderboard
    return leaderboard(_trtr_long(spark, d), "accuracy").withColumn("rank", F.col("rank").cast("int"))


@register("metric_chart_data", _trtr_sql_body() + " SELECT dataset, model, value FROM res")
def q_metric_chart_data(spark, d):
    """Series behind the accuracy bar chart."""
    from bayesloom.operators.report import metric_chart_data
    return metric_chart_data(_trtr_long(spark, d), "accuracy")


# ------------------------------------------------------------------ S: sources and sinks

@register("csv_labelled_roundtrip", f"WITH {O.view_cte('li')} SELECT row_key, qty_b, price_b, disc_b, tax_b, status AS line_status, target FROM li")
def q_csv_roundtrip(spark, d):
    """S5 + S1 + P14: write the view as CSV, read it back as a labelled table."""
    from bayesloom.sources.readers import read_csv_labelled, shared_path, write_csv
    v = _li(spark, d)
    out = v.df.select("row_key", *_FEATS[:4], F.col("status").alias("line-status"), F.col("target").alias("return-flag"))
    path = write_csv(out, shared_path(spark, "li_csv"))
    return read_csv_labelled(spark, path)


@register("arff_roundtrip", "SELECT l_quantity, l_discount, l_linestatus, l_returnflag AS target FROM lineitem")
def q_arff_roundtrip(spark, d):
    """S2 + S3 + S4: lineitem columns written as ARFF, read back through the dataset catalog."""
    from bayesloom.sources.readers import load_dataset, shared_path, write_arff
    li = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_linestatus", F.col("l_returnflag").alias("class"))
    path = write_arff(li, shared_path(spark, "li_arff"), "lineitem")
    return load_dataset(spark, "li", {"li": ("arff", [path + "/header", path + "/body"], "class")})


@register("export_ordinal_matrix", "SELECT CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS l_linestatus, "
          "CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag FROM lineitem")
def q_export_ordinal(spark, d):
    """Ordinal-encode and export the integer matrix (parquet), read back."""
    from bayesloom.sources.readers import export_ordinal_matrix, shared_path
    path = shared_path(spark, "ordinal")
    export_ordinal_matrix(read(spark, d, "lineitem"), ["l_linestatus", "l_returnflag"], path)
    return spark.read.parquet(path)


@register("write_sample", _SAMPLE_SQL + " SELECT * FROM sample WHERE row_id < 1000")
def q_write_sample(spark, d):
    """The first 1000 synthetic rows (by row id) exported as CSV, read back."""
    from bayesloom.sources.readers import shared_path, write_sample
    v, cp = _naive_cpts(spark, d)
    s = ancestral_sample(spark, cp, _NAIVE, v.nodes, v.cards(), v.df.count(), seed=42)
    path = write_sample(s, shared_path(spark, "sample"), 1000)
    return spark.read.option("header", True).schema(s.schema).csv(path)


@register("import_adjacency", ORACLE["kdb_edges"])
def q_import_adjacency(spark, d):
    """The kDB feature edges as a 0/1 adjacency matrix, imported on top of label → feature."""
    v = _li(spark, d)
    edges = K.kdb_structure(v.df, v.features, v.label, 2)
    idx = {f: i for i, f in enumerate(v.features)}
    m = [[0] * len(v.features) for _ in v.features]
    for s_, t in edges:
        if s_ != v.label:
            m[idx[s_]][idx[t]] = 1
    return K.edges_df(spark, K.import_adjacency(m, v.features, v.label))


@register("run_log", f"WITH {O.view_cte('li')}, sh AS (SELECT 'share_' || target AS metric, round(count(*) * 1e0 / (SELECT count(*) FROM li), 9) AS value "
          "FROM li GROUP BY target) SELECT 'log' AS kind, 'li' AS dataset, metric, value FROM sh UNION ALL SELECT 'results', 'li', metric, value FROM sh")
def q_run_log(spark, d):
    """S7 + S8: write the results per metric and append them to a run log in two goes, read files and log back."""
    from bayesloom.sources.readers import append_run_log, shared_path, write_results
    v = _li(spark, d)
    res = E.class_counts(v.df, "target").select(F.lit("li").alias("dataset"), F.lit("prior").alias("model"),
                                                F.concat(F.lit("share_"), F.col("target").cast("string")).alias("metric"),
                                                F.round("share", 9).alias("value"))
    files = write_results(res, shared_path(spark, "results"))
    log = shared_path(spark, "runlog")
    for r in res.collect():  # a row per class
        append_run_log(spark, log, r.dataset, {r.metric: r.value})
    back = spark.read.option("header", True).schema(res.schema).csv(files).withColumn("kind", F.lit("results"))
    return spark.read.parquet(log).withColumn("kind", F.lit("log")).select("kind", "dataset", "metric", "value").unionByName(
        back.select("kind", "dataset", "metric", "value"))


# ------------------------------------------------------------------ M: mixture discretiser

_MIX = ["l_quantity", "l_extendedprice"]


def _mix_sql_ctes() -> str:
    cols = ", ".join(f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) AS {c}"
                     for c in _MIX)
    stats = ", ".join(f"round(avg({c}), 12) AS mu_{c}, round(sqrt(var_pop({c}) + 1e-6), 12) AS sg_{c}" for c in _MIX)
    return (f"sc AS (SELECT {LI_KEY} AS row_key, {cols} FROM lineitem), st AS (SELECT {stats} FROM sc)")


def _twelve_digits(m):
    """Sums of doubles differ in their last digits with the order of the rows; twelve digits of the parameters don't."""
    m.mu = {c: [round(x, 12) for x in v] for c, v in m.mu.items()}
    m.sigma = {c: [round(x, 12) for x in v] for c, v in m.sigma.items()}
    return m


def _zbin_sql(z: str) -> str:
    return " + ".join(f"CAST({z} > {e} AS INTEGER)" for e in (-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0))


@register("mixture_discretise", "WITH " + _mix_sql_ctes() + " SELECT row_key, " + ", ".join(
    f"{_zbin_sql(f'(({c} - mu_{c}) / sg_{c})')} AS {c}" for c in _MIX) + " FROM sc, st")
def q_mixture_discretise(spark, d):
    """M1–M3 with one mode per column: code = 8·mode + z-bin of the min-max-scaled value."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    li = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *_MIX)
    m = _twelve_digits(MixtureDiscretiser.fit(li, _MIX, k=1, method="em"))
    return m.transform(li).select("row_key", *_MIX)


def _mix_decode_sql() -> str:
    from bayesloom.operators.discretise import PHI_EDGES
    cols = []
    for c in _MIX:
        z = f"(({c} - mu_{c}) / sg_{c})"
        b = f"({_zbin_sql(z)})"
        lo = "CASE " + " ".join(f"WHEN {b} = {i} THEN {PHI_EDGES[i]!r}" for i in range(8)) + " END"
        hi = "CASE " + " ".join(f"WHEN {b} = {i} THEN {PHI_EDGES[i + 1]!r}" for i in range(8)) + " END"
        u = O.u_sql("row_key", c)
        p = f"least(greatest(({lo}) + (({hi}) - ({lo})) * {u}, 1e-15), {1 - 1e-15!r})"
        zz = O.probit(f"({p})")
        cols.append(f"round((mu_{c} + sg_{c} * {zz}) * ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) "
                    f"+ (SELECT min({c}) FROM lineitem), 4) AS {c}")
    return "WITH " + _mix_sql_ctes() + " SELECT row_key, " + ", ".join(cols) + " FROM sc, st"


@register("mixture_decode", _mix_decode_sql())
def q_mixture_decode(spark, d):
    """M4 + M5: codes back to values, truncated normal inside the bin, then un-scaled."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    li = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *_MIX)
    m = _twelve_digits(MixtureDiscretiser.fit(li, _MIX, k=1, method="em"))
    back = m.inverse(m.transform(li), "row_key", 42)
    return back.select("row_key", *[_r(c, 4).alias(c) for c in _MIX])


@register("mixture_fit")
def q_mixture_fit(spark, d):
    """M1: Dirichlet-process mixture of ten components per column, to convergence; the modes in use, and how the fit ended."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    m = MixtureDiscretiser.fit(read(spark, d, "lineitem").select(*_MIX), _MIX)
    rows = [(c, j, m.weights[c][j], m.mu[c][j], m.sigma[c][j], *m.ends[c]) for c in _MIX for j in range(len(m.mu[c]))]
    return spark.createDataFrame(rows, "col_name string, mode int, weight double, mu double, sigma double, converged boolean, steps int")


@register("mixed_synth_sample")
def q_mixed_synth(spark, d):
    """M6: numeric columns through the mixture codes, kDB generator, decoded sample of N rows."""
    from bayesloom.plans.models import MixedSynthesizer
    v = _li(spark, d)
    raw = read(spark, d, "lineitem").select(F.expr(LI_KEY).alias("row_key"), *_MIX)
    df = cached(v.df.select("row_key", "disc_b", "tax_b", "status", "target").join(raw, "row_key").drop("row_key"))  # read by every fit
    m = MixedSynthesizer(numeric=_MIX)
    m.fit(df, _MIX + ["disc_b", "tax_b", "status"], "target", v.cards())
    n = int(df.count())
    df.unpersist()
    return m.sample(n, 42)


# ------------------------------------------------------------------ iterative models and evaluation (no SQL form)

def _generator(spark, d):
    from bayesloom.plans.models import KDependenceGenerator
    v = _li(spark, d)
    return v, KDependenceGenerator(k=2).fit(v.df, v.features, v.label, v.cards())


@register("kdb_generator_sample", generator_sql.generator_sample("li", O.LI_FEATURES, "target"))
def q_kdb_generator(spark, d):
    """G12 (K1 + K5 + G3 + G4 + G6): discriminatively tuned kDB, N synthetic rows."""
    v, g = _generator(spark, d)
    return g.sample(int(v.df.count()), 42)


@register("kdb_generator_cpts", generator_sql.generator_cpts("li", O.LI_FEATURES, "target"))
def q_kdb_generator_cpts(spark, d):
    """G3 + G4: the tuned weights as CPT rows (each configuration sums to 1)."""
    pa = F.concat_ws(",", F.transform("pa", lambda x: x.cast("string")))
    return _generator(spark, d)[1].cpts.select("child", pa.alias("pa"), "value", _r("p").alias("p"))


_SMALL = ["nation", "region"]
_SEARCH = {"episodes": 3, "epochs": 3, "n": 1, "epsilon": 0.5}


@functools.lru_cache(1)
def _last_search(application: str, d: str):
    """The small search of this session and folder: its queries are tables of one run."""
    from bayesloom.operators.search import HybridSearch
    v = model_view(SparkSession.getActiveSession(), d, "cust")
    return HybridSearch([*_SMALL, "target"], "target", v.cards(), gan=False, **_SEARCH).run(v.df)


def _search(spark, d):
    return _last_search(spark.sparkContext.applicationId, d)


@register("hybrid_search_log", search_sql.hybrid_search(_SMALL, "target", **_SEARCH) + "SELECT episode, epoch, step, state_key, action, "
          "round(reward, 6) AS reward, next_state_key, 0e0 AS ls FROM log")
def q_search_log(spark, d):
    """K27 (with K10–K12, K16–K23): transition log of three lock-step episodes over customers."""
    return _search(spark, d).log.withColumn("reward", _r("reward"))


@register("hybrid_search_q", search_sql.hybrid_search(_SMALL, "target", **_SEARCH) + "SELECT state_key, action, 'q' AS kind, round(avg(q), 6) AS value FROM "
          "qs GROUP BY state_key, action UNION ALL SELECT state_key, action, 'policy', round(avg(value), 6) FROM ps GROUP BY state_key, action")
def q_search_q(spark, d):
    """K24 in K27: Q and policy averaged over all episodes' snapshots."""
    r = _search(spark, d)
    return (r.q.select("state_key", "action", F.lit("q").alias("kind"), _r("q").alias("value"))
            .unionByName(r.policy.select("state_key", "action", F.lit("policy").alias("kind"), _r("value").alias("value"))))


@register("hybrid_search_best", search_sql.hybrid_search(_SMALL, "target", **_SEARCH) + "SELECT state_key, edges, round(score, 6) AS score FROM reached "
          "ORDER BY round(reached.score, 9) DESC, state_key LIMIT 1")
def q_search_best(spark, d):
    """K25 in K27: the best structure reached after any step."""
    from bayesloom.operators.search import select_best_structure
    return select_best_structure(_search(spark, d).candidates).select("state_key", "edges", _r("score").alias("score"))


@register("hybrid_search_gan")
def q_search_gan(spark, d):
    """K27 + V7: the search over line items with the operator's defaults, discriminator and all."""
    from bayesloom.operators.search import HybridSearch
    v = _li(spark, d)
    return HybridSearch(v.nodes, v.label, v.cards()).run(v.df).log


def _tstr_setup(spark, d):
    from bayesloom.plans.models import BayesNetSynthesizer
    v, sp = _li_split(spark, d)
    sp = sp.persist()
    tr, te = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    b = BayesNetSynthesizer("naive").fit(tr, v.features, v.label, v.cards())
    return v, sp, tr, te, b


@register("tstr")
def q_tstr(spark, d):
    """V1 + V2 + V6: naive-BN synthetic rows → logistic regression → accuracy on real test rows."""
    v, sp, tr, te, b = _tstr_setup(spark, d)
    res = b.evaluate(te.select(*v.nodes), n=int(tr.count()), classifiers=("lr",))
    sp.unpersist()
    return spark.createDataFrame([(k, val) for k, val in res.items()], "metric string, value double")


def _discriminator_sql(steps: int = 12, frac: float = 0.8, seed: int = 42) -> str:
    """The logistic model by full-batch gradient steps over real train rows and as many drawn ones."""
    from bayesloom.functions import hash_uniform_sql
    d = len(_FEATS)
    stack = lambda key, y, t: f"SELECT CAST({key} AS VARCHAR) AS k, {y} AS y, {', '.join(f'{f} * 1e0 AS x{i}' for i, f in enumerate(_FEATS))} FROM {t}"
    xs = ", ".join(f"x{i}" for i in range(d))
    u = hash_uniform_sql("'0'", "k", "y::VARCHAR", f"'{seed}'", dialect="duckdb")
    ctes = [O.view_cte("li"), O.split_cte("li"), "tr AS (SELECT * FROM split WHERE NOT is_test)",
            O.naive_sample_ctes("tr", _FEATS, "target", 7, cards=O.li_cards_sql()),
            f"al AS ({stack('row_key', 1, 'tr')} UNION ALL {stack('row_id', 0, 'sample')})",
            f"rw AS MATERIALIZED (SELECT y, {xs}, sum(CASE WHEN {u} < {frac} THEN 1e0 ELSE 0e0 END) AS w, count(*) * 1e0 AS n FROM al GROUP BY y, {xs})",
            "st AS MATERIALIZED (SELECT sum(w) AS nn, " + ", ".join(f"sum(w * x{i}) / sum(w) AS m{i}, sqrt(sum(w * x{i} * x{i}) / sum(w) - power(sum(w * x{i}) / sum(w), 2)) AS s{i}"
                                                        for i in range(d)) + " FROM rw)",
            "zr AS MATERIALIZED (SELECT y, w, n, nn, " + ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in range(d)) + ", 1e0 AS z" + str(d) + " FROM rw, st)",
            "b0 AS (SELECT " + ", ".join(f"0e0 AS b{i}" for i in range(d + 1)) + ")"]
    logit = " + ".join(f"b{i} * z{i}" for i in range(d + 1))
    for t in range(steps):
        ctes.append(f"b{t + 1} AS MATERIALIZED (SELECT " + ", ".join(
            f"any_value(b{i}) + {4 / (d + 1)!r} * sum(w * (y - 1 / (1 + exp(-({logit})))) * z{i}) / any_value(nn) AS b{i}" for i in range(d + 1)) + f" FROM zr, b{t})")
    return ("WITH " + ", ".join(ctes) + f", f AS (SELECT y, w, n, {logit} AS l FROM zr, b{steps}) "
            "SELECT 'ls' AS metric, round(sum(w * CASE WHEN (round(l, 9) > 0) = (y = 1) THEN 1 ELSE 0 END) / sum(w), 6) AS value FROM f "
            "UNION ALL SELECT 'p_real', round(sum(n / (1 + exp(-l))) / sum(n), 6) FROM f WHERE y = 1")


@register("discriminator", _discriminator_sql())
def q_discriminator(spark, d):
    """V7 (+G13, P8): real-vs-synthetic logistic discriminator accuracy on an 80 % sample."""
    from bayesloom.operators.evaluate import discriminator
    v, sp, tr, te, b = _tstr_setup(spark, d)
    syn = b.sample(int(tr.count()), 7)
    res = discriminator(tr, syn, v.features)
    sp.unpersist()
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in res.items()], "metric string, value double")


@register("trtr_structures")
def q_trtr_structures(spark, d):
    """V8: train-on-real MAP accuracy of hill-climb, tree and kDB networks."""
    from bayesloom.operators.evaluate import accuracy
    from bayesloom.plans.models import BayesNetSynthesizer
    v, sp = _li_split(spark, d)
    counted = S.compacted(sp, [*v.nodes, "is_test"])  # one pass over the rows; the networks count and predict the distinct ones
    tr, te = counted.filter(~F.col("is_test")), counted.filter(F.col("is_test"))
    rows = []
    for name in ("hill_climb", "tree", "kdb"):
        b = BayesNetSynthesizer(name).fit(tr, v.features, v.label, v.cards(), weight="w")
        if not any(v.label in e for e in b.edges):
            rows.append((name, None))
            continue
        p = bn_map_predict(te, b.cpts, b.edges, v.nodes, v.label, v.cards())
        rows.append((name, float(accuracy(p, "pred", v.label, "w").first()[0])))
    counted.unpersist()
    return spark.createDataFrame(rows, "model string, accuracy double")


@register("multi_round")
def q_multi_round(spark, d):
    """Generate once per model, evaluate two rounds (LR), mean over rounds."""
    from bayesloom.operators.evaluate import mean_over_rounds, multi_round
    from bayesloom.plans.models import BayesNetSynthesizer, GaussianNBSynthesizer
    v, sp = _li_split(spark, d)
    sp = sp.select(*v.nodes, "is_test").persist()
    tr, te = sp.filter(~F.col("is_test")).select(*v.nodes), sp.filter(F.col("is_test")).select(*v.nodes)
    models = {
        "naive_bn": lambda t, y: BayesNetSynthesizer("naive").fit(t, v.features, y, v.cards()),
        "kdb": lambda t, y: BayesNetSynthesizer("kdb").fit(t, v.features, y, v.cards()),
        "gnb": lambda t, y: GaussianNBSynthesizer().fit(t, v.features, y),
    }
    res = multi_round(spark, {"li": (tr, te, v.label)}, models, rounds=2, classifiers=("lr",)).persist()
    out = mean_over_rounds(res.filter("metric != 'seconds'"))
    out.count()
    sp.unpersist()
    return out


# ------------------------------------------------------------------ V1, V11 with a MAP network as the classifier


def _gnb_synthetic_sql(seed: int = 42) -> str:
    """CTEs ``gs`` (as many Gaussian rows as ``tr`` has) and ``gc`` (their numbers in the cells of the test rows' codes)."""
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    draw = lambda i, f: (f"(SELECT mean FROM gnb WHERE gnb.y = g1.target AND gnb.f = '{f}') + sqrt((SELECT var FROM gnb WHERE gnb.y = g1.target AND "  # noqa: E731
                         f"gnb.f = '{f}')) * {O.probit('(' + O.ub_sql('g1.row_id', i, seed) + ')')} AS {f}")
    ut = O.ub_sql("g0.row_id", len(_FEATS), seed)
    # a cell per code of the test rows, its ends half way to the next ones
    cell = lambda f: (f"(SELECT any_value(v) FROM (SELECT v, (lag(v) OVER (ORDER BY v) + v) / 2e0 AS a, (lead(v) OVER (ORDER BY v) + v) / 2e0 AS b "  # noqa: E731
                      f"FROM (SELECT DISTINCT {f} AS v FROM te)) WHERE (a IS NULL OR gs.{f} >= a) AND (b IS NULL OR gs.{f} < b)) AS {f}")
    return (f"{_gnb_sql_params('tr')}, gcum AS (SELECT y, (sum(n) OVER (ORDER BY y {run}) - n) * 1e0 / sum(n) OVER () AS lo, "
            f"sum(n) OVER (ORDER BY y {run}) * 1e0 / sum(n) OVER () AS hi FROM gnb_prior), g0 AS (SELECT row_number() OVER () - 1 AS row_id FROM tr), "
            f"g1 AS (SELECT g0.row_id, gcum.y AS target FROM g0 JOIN gcum ON {ut} >= gcum.lo AND {ut} < gcum.hi), "
            f"gs AS (SELECT row_id, target, {', '.join(draw(i, f) for i, f in enumerate(_FEATS))} FROM g1), "
            f"gc AS (SELECT row_id, target, {', '.join(cell(f) for f in _FEATS)} FROM gs)")


def _hits_sql(pred: str) -> str:
    return f"(SELECT round(avg(CASE WHEN pred = target THEN 1e0 ELSE 0e0 END), 6) FROM {pred} JOIN te USING (row_key))"


_MAP_SAMPLE = f"{_split_tables()}, {O.naive_sample_ctes('tr', _FEATS, 'target', 42, cards=O.li_cards_sql())}, {O.naive_map_ctes('sample', 'te', _FEATS, 'target')}"


@register("tstr_map", f"{_MAP_SAMPLE} SELECT unnest(['map', 'avg']) AS metric, {_hits_sql('pred')} AS value")
def q_tstr_map(spark, d):
    """V1 over all features of the line items: naive-network rows, a MAP network fitted on them, accuracy on the real test rows."""
    from bayesloom.operators.evaluate import MapClassifier
    v, sp, tr, te, b = _tstr_setup(spark, d)
    res = b.evaluate(te.select(*v.nodes), n=int(tr.count()), classifiers=(("map", MapClassifier),))
    sp.unpersist()
    return spark.createDataFrame([(k, round(x, 6)) for k, x in res.items()], "metric string, value double")


@register("multi_round_map", f"{_MAP_SAMPLE}, {_gnb_synthetic_sql()}, {O.naive_map_ctes('gc', 'te', _FEATS, 'target', 'gp')}, "
          f"r AS (SELECT 'naive_bn' AS model, {_hits_sql('pred')} AS value UNION ALL SELECT 'gnb', {_hits_sql('gp')}) "
          "SELECT 'li' AS dataset, model, unnest(['map', 'avg']) AS metric, value FROM r")
def q_multi_round_map(spark, d):
    """A discrete and a continuous sample generated once each, two rounds with a MAP network, mean over rounds."""
    from bayesloom.operators.evaluate import MapClassifier, mean_over_rounds, multi_round
    from bayesloom.plans.models import BayesNetSynthesizer, GaussianNBSynthesizer
    v, sp = _li_split(spark, d)
    sp = sp.select(*v.nodes, "is_test").persist()
    tr, te = sp.filter(~F.col("is_test")).select(*v.nodes), sp.filter(F.col("is_test")).select(*v.nodes)
    models = {"naive_bn": lambda t, y: BayesNetSynthesizer("naive").fit(t, v.features, y, v.cards()),
              "gnb": lambda t, y: GaussianNBSynthesizer().fit(t, v.features, y)}
    res = multi_round(spark, {"li": (tr, te, v.label)}, models, rounds=2, classifiers=(("map", MapClassifier),))
    sp.unpersist()
    return mean_over_rounds(res.filter("metric != 'seconds'")).withColumn("value", _r("value"))
