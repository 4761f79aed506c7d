"""Registered queries whose inputs reach the branches that make an operator: a real transition log (events), sparse
tables (parts), missing values (documents without labels), a label that is a function of a feature (customers), and a
network with several parents per node.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bayesloom.operators import counts as C
from bayesloom.operators import encode as E
from bayesloom.operators import scores as S
from bayesloom.operators import search as RL
from bayesloom.operators import select as SEL
from bayesloom.operators import structure as K
from bayesloom.operators.cpt import fit_cpts
from bayesloom.operators.predict import bn_map_predict
from bayesloom.operators.sample import ancestral_sample
from bayesloom.plans import oracle_sql as O
from bayesloom.plans.queries import _li, _li_split, _r, _split_tables, register
from bayesloom.sources.tables import model_view, read

# ------------------------------------------------------------------ K20–K26 on the events table

# episode = user, epoch = day, step = order within the day, state = the user's last event, action = this event
_LOG_SQL = ("log AS (SELECT user_id AS episode, CAST(ts AS DATE) AS epoch, "
            "row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS step, "
            "coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'start') AS state_key, "
            "event_type AS action, value AS reward, (event_id % 7) / 7.0 AS ls, day(ts) <= 15 AS early FROM events)")
_GAIN_SQL = ("gain AS (SELECT early, episode, epoch, sum(reward * (1 - ls) * pow(0.9, step)) AS g, max(step) AS last FROM log GROUP BY early, episode, epoch), "
             "upd AS (SELECT l.early, l.state_key, l.action, avg(g) AS g FROM gain JOIN log l ON l.episode = gain.episode AND l.epoch = gain.epoch AND l.step = last "
             "GROUP BY l.early, l.state_key, l.action), "
             "q0 AS (SELECT state_key, action, 0.1 * g AS q FROM upd WHERE early), "
             "q1 AS (SELECT coalesce(q0.state_key, u.state_key) AS state_key, coalesce(q0.action, u.action) AS action, "
             "CASE WHEN u.g IS NULL THEN q0.q ELSE coalesce(q0.q, 0) + 0.1 * (u.g - coalesce(q0.q, 0)) END AS q "
             "FROM q0 FULL OUTER JOIN (SELECT * FROM upd WHERE NOT early) u ON q0.state_key = u.state_key AND q0.action = u.action)")
_RL = f"WITH {_LOG_SQL}, {_GAIN_SQL} "


def _event_log(spark, d) -> DataFrame:
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    by_day = Window.partitionBy("user_id", "epoch").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("epoch", F.to_date("ts"))
    return e.select(F.col("user_id").alias("episode"), "epoch", (F.row_number().over(by_day) - 1).alias("step"),
                    F.coalesce(F.lag("event_type").over(by_user), F.lit("start")).alias("state_key"), F.col("event_type").alias("action"),
                    F.col("value").alias("reward"), F.col("event_type").alias("next_state_key"), (F.col("event_id") % 7 / 7.0).alias("ls"),
                    (F.dayofmonth("ts") <= 15).alias("early"))


def _event_q(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log, the Q table of its first half and that table updated by the second half."""
    log = _event_log(spark, d)
    q0 = RL.q_update(spark.createDataFrame([], RL.Q_SCHEMA), log.filter("early"))
    return log, q0, RL.q_update(q0, log.filter("not early"))


@register("step_reward", f"WITH {_LOG_SQL}, pen AS (SELECT 5 / 2.0 * ln(count(*)) AS p FROM events) "
          "SELECT episode, epoch, step, round(reward - lag(reward) OVER (PARTITION BY episode ORDER BY epoch, step) - p, 6) AS reward FROM log, pen")
def q_step_reward(spark, d):
    """K20 + K19: score difference to the step before, less the complexity penalty of five nodes."""
    log = _event_log(spark, d)
    penalty = S.complexity_penalty(5, log.count())
    scores = log.select("episode", "epoch", "step", F.col("reward").alias("score"))
    return RL.step_reward(scores, penalty).select("episode", "epoch", "step", _r("reward").alias("reward"))


@register("n_step_return", _RL + "SELECT episode, epoch, round(g, 6) AS g FROM gain")
def q_n_step_return(spark, d):
    """Discounted return of every (user, day)."""
    return RL.n_step_return(_event_log(spark, d), 0.9).select("episode", "epoch", _r("g").alias("g"))


@register("q_update", _RL + "SELECT state_key, action, round(q, 6) AS q FROM q1")
def q_q_update(spark, d):
    """The Q table of the first half of the month, updated by the second half."""
    return _event_q(spark, d)[2].select("state_key", "action", _r("q").alias("q"))


@register("q_merge", _RL + "SELECT state_key, action, round(avg(q), 6) AS q FROM (SELECT * FROM q0 UNION ALL SELECT * FROM q1) GROUP BY state_key, action")
def q_q_merge(spark, d):
    """Average of two snapshots of the Q table."""
    _, q0, q1 = _event_q(spark, d)
    return RL.q_merge([q0, q1]).select("state_key", "action", _r("q").alias("q"))


@register("policy_blend", _RL + ", fst AS (SELECT *, row_number() OVER (PARTITION BY state_key, action ORDER BY episode, epoch, step) AS rn FROM log), "
          "pol AS (SELECT f.state_key, f.action, 0.9 * reward * (1 - ls) + 0.1 * q AS value, early FROM fst f JOIN q0 USING (state_key, action) WHERE rn = 1 AND early), "
          "f2 AS (SELECT *, row_number() OVER (PARTITION BY state_key, action ORDER BY episode, epoch, step) AS rn FROM log WHERE NOT early), "
          "p2 AS (SELECT f2.state_key, f2.action, 0.5 * reward * (1 - ls) + 0.5 * q AS value FROM f2 JOIN q1 USING (state_key, action) WHERE rn = 1), "
          "f1 AS (SELECT *, row_number() OVER (PARTITION BY state_key, action ORDER BY episode, epoch, step) AS rn FROM log WHERE early), "
          "p1 AS (SELECT f1.state_key, f1.action, 0.9 * reward * (1 - ls) + 0.1 * q AS value FROM f1 JOIN q0 USING (state_key, action) WHERE rn = 1) "
          "SELECT state_key, action, round(value, 6) AS value FROM p2 UNION ALL "
          "SELECT state_key, action, round(value, 6) FROM p1 WHERE (state_key, action) NOT IN (SELECT (state_key, action) FROM p2)")
def q_policy_blend(spark, d):
    """Policy of the first half of the month, overwritten by the second half where it has the pair."""
    log, q0, q1 = _event_q(spark, d)
    first = RL.policy_blend(None, q0, log.filter("early"), 0.9)
    return RL.policy_blend(first, q1, log.filter("not early"), 0.5).select("state_key", "action", _r("value").alias("value"))


@register("best_known_action", _RL + "SELECT state_key, action, round(q, 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY q DESC, action) AS rn FROM q1) WHERE rn = 1 AND q >= 0")
def q_best_known_action(spark, d):
    """Argmax-Q action of every state."""
    return RL.best_known_action(_event_q(spark, d)[2]).select("state_key", "action", _r("q").alias("q"))


@register("select_best_structure", f"WITH {_LOG_SQL}, e AS (SELECT DISTINCT episode, state_key || '>' || action AS e FROM log), "
          "g AS (SELECT episode, string_agg(e, ';' ORDER BY e) AS edges FROM e GROUP BY episode), "
          "s AS (SELECT episode, count(DISTINCT state_key || '>' || action) * 1e0 AS score FROM log GROUP BY episode) "
          "SELECT sha256(edges) AS state_key, edges, score FROM g JOIN s USING (episode) ORDER BY score DESC, sha256(edges) LIMIT 1")
def q_select_best_structure(spark, d):
    """K25 + K18: of every user's transition graph the one with most edges (ties: the smallest state key)."""
    log = _event_log(spark, d)
    edge = F.concat_ws(">", "state_key", "action")
    graphs = log.groupBy("episode").agg(F.array_sort(F.collect_set(edge)).alias("e"))
    text = F.concat_ws(";", "e")
    cands = graphs.select(F.sha2(text, 256).alias("state_key"), text.alias("edges"), F.size("e").cast("double").alias("score"))
    return RL.select_best_structure(cands)


# ------------------------------------------------------------------ sparse tables: back-off, noise, unseen codes

_PRT = O.view_cte("prt")
_PRT_CARDS = {"size_b": 5, "price_b": 5, "brand": "(SELECT count(DISTINCT p_brand) FROM part)", "target": "(SELECT count(DISTINCT p_type) FROM part)"}


@register("smooth_backoff_sparse",
          f"WITH {_PRT}, dom AS (SELECT * FROM range({_PRT_CARDS['target']}) a(target), range(5) b(price_b), range({_PRT_CARDS['brand']}) c(brand)), "
          "l2 AS (SELECT target, price_b, brand, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY price_b, brand) AS p2 FROM prt GROUP BY target, price_b, brand), "
          "l1 AS (SELECT target, price_b, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY price_b) AS p1 FROM prt GROUP BY target, price_b), "
          "l0 AS (SELECT target, count(*) * 1e0 / sum(count(*)) OVER () AS p0 FROM prt GROUP BY target) "
          "SELECT dom.target, dom.price_b, dom.brand, p2 IS NULL AS backed_off, round(coalesce(p2, p1, p0, 0.0), 6) AS p "
          "FROM dom LEFT JOIN l2 USING (target, price_b, brand) LEFT JOIN l1 USING (target, price_b) LEFT JOIN l0 USING (target)")
def q_smooth_backoff_sparse(spark, d):
    """C4 where cells are empty: type given price and brand of the parts."""
    v = model_view(spark, d, "prt")
    out = C.smooth_backoff(v.df, "target", ["price_b", "brand"], v.cards())
    seen = v.df.select("target", "price_b", "brand").distinct().withColumn("seen", F.lit(True))
    return out.join(seen, ["target", "price_b", "brand"], "left").select(
        "target", "price_b", "brand", F.col("seen").isNull().alias("backed_off"), _r("p").alias("p"))


@register("add_uniform_sparse",
          f"WITH {_PRT}, dom AS (SELECT * FROM range({_PRT_CARDS['target']}) a(target), range(5) b(price_b), range({_PRT_CARDS['brand']}) c(brand), range(5) e(size_b)), "
          "ct AS (SELECT target, price_b, brand, size_b, count(*) * 1e0 AS n FROM prt GROUP BY ALL), "
          "dn AS (SELECT dom.*, coalesce(n, 0.0) AS n FROM dom LEFT JOIN ct USING (target, price_b, brand, size_b)), "
          "nz AS (SELECT *, n + CASE WHEN n = 0 THEN 1e-5 ELSE 0.0 END AS nn, sum(n) OVER w AS cs, count(*) OVER w AS k FROM dn WINDOW w AS (PARTITION BY price_b, brand, size_b)) "
          "SELECT target, price_b, brand, size_b, cs = 0 AS empty_parents, "
          "round(CASE WHEN cs = 0 THEN 1.0 / k ELSE nn / sum(nn) OVER (PARTITION BY price_b, brand, size_b) END, 9) AS p FROM nz")
def q_add_uniform_sparse(spark, d):
    """C5 with zero cells (noise) and empty parent configurations (uniform)."""
    v = model_view(spark, d, "prt")
    cols, pa = ["target", "price_b", "brand", "size_b"], ["price_b", "brand", "size_b"]
    dense = C.dense_domain(spark, cols, v.cards()).join(C.cross_table(v.df, cols), cols, "left")
    out = C.add_uniform(dense, "target", pa, noise=1e-5)
    total = out.groupBy(*pa).agg((F.coalesce(F.sum("n"), F.lit(0.0)) == 0).alias("empty_parents"))
    return out.join(total, pa).select(*cols, "empty_parents", _r("p", 9).alias("p"))


_PRT_SPLIT = f"WITH {_PRT}, {O.split_cte('prt')}"


@register("high_order_unseen", _PRT_SPLIT + ", c AS (SELECT row_key, is_test, (price_b * (SELECT max(brand) + 1 FROM prt) + brand) * 5 + size_b AS code FROM split), "
          "voc AS (SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS o FROM (SELECT DISTINCT code FROM c WHERE NOT is_test)) "
          "SELECT row_key, coalesce(o, -1) AS size_b_ho FROM c LEFT JOIN voc USING (code) WHERE is_test")
def q_high_order_unseen(spark, d):
    """K3/K5: combinations fitted on the train rows; those that only test rows have give −1."""
    v = model_view(spark, d, "prt")
    sp = SEL.stratified_split(v.df, v.label, "row_key", 0.2, 42)
    edges = [(v.label, "size_b"), ("price_b", "size_b"), ("brand", "size_b")]
    enc = K.HighOrderEncoder(["size_b"], v.label, 2, v.cards(), {"size_b": ["price_b", "brand"]}, edges=edges).fit_vocabulary(sp.filter("not is_test"))
    return enc.transform(sp.filter("is_test")).select("row_key", "size_b_ho")


@register("ordinal_encode_unseen", _PRT_SPLIT + ", raw AS (SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_partkey, p_name FROM part), "
          "tr AS (SELECT raw.* FROM raw JOIN split USING (row_key) WHERE NOT is_test), te AS (SELECT raw.* FROM raw JOIN split USING (row_key) WHERE is_test), "
          "d1 AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS code FROM tr), "
          "d2 AS (SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_name FROM tr)) "
          "SELECT row_key, false AS fitted, coalesce(d1.code, -1) AS p_partkey, coalesce(d2.code, -1) AS p_name FROM te LEFT JOIN d1 USING (p_partkey) LEFT JOIN d2 USING (p_name) "
          "UNION ALL SELECT row_key, true, d1.code, d2.code FROM tr JOIN d1 USING (p_partkey) JOIN d2 USING (p_name)")
def q_ordinal_encode_unseen(spark, d):
    """P2 with thousands of categories (part keys), none of a test row's known, and with names."""
    v = model_view(spark, d, "prt")
    sp = SEL.stratified_split(v.df, v.label, "row_key", 0.2, 42).select("row_key", "is_test")
    raw = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("row_key"), "p_partkey", "p_name").join(sp, "row_key")
    enc = E.CategoryEncoder.fit(raw.filter("not is_test"), ["p_partkey", "p_name"])
    return enc.transform(raw).select("row_key", (~F.col("is_test")).alias("fitted"), "p_partkey", "p_name")


@register("bn_map_predict_unseen", _PRT_SPLIT + ", tr AS (SELECT * FROM split WHERE NOT is_test AND brand <> 0), "
          "pr AS (SELECT target, ln(count(*) * 1e0 / sum(count(*)) OVER ()) AS lp FROM tr GROUP BY target), "
          "ct AS (SELECT target, brand, size_b, ln(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY target, brand)) AS lp FROM tr GROUP BY target, brand, size_b), "
          "sn AS (SELECT DISTINCT target, brand FROM tr), "
          "sb AS (SELECT target, brand, ln(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY target)) AS lp FROM tr GROUP BY target, brand), "
          "sc AS (SELECT s.row_key, pr.target AS y, s.brand = 0 AS unseen, pr.lp + coalesce(sb.lp, -1e300) + CASE WHEN sn.target IS NULL THEN ln(1 / 5.0) ELSE coalesce(ct.lp, -1e300) END AS lp, "
          "pr.lp + ln(1.0 / (SELECT max(brand) FROM prt)) + ln(1 / 5.0) AS lp0 "
          "FROM (SELECT * FROM split WHERE is_test) s CROSS JOIN pr LEFT JOIN sb ON sb.target = pr.target AND sb.brand = s.brand "
          "LEFT JOIN sn ON sn.target = pr.target AND sn.brand = s.brand LEFT JOIN ct ON ct.target = pr.target AND ct.brand = s.brand AND ct.size_b = s.size_b), "
          "bs AS (SELECT row_key, unseen, y, CASE WHEN unseen THEN round(lp0, 9) ELSE round(lp, 9) END AS l FROM sc) "
          "SELECT row_key, unseen, CASE WHEN max(l) <= -5e299 THEN NULL ELSE CAST(min(CASE WHEN l = m THEN y END) AS INTEGER) END AS pred FROM "
          "(SELECT *, max(l) OVER (PARTITION BY row_key) AS m FROM bs) GROUP BY row_key, unseen")
def q_map_unseen(spark, d):
    """G11 on codes that training never saw: brand 0 is held out and reaches the network as −1."""
    v = model_view(spark, d, "prt")
    sp = SEL.stratified_split(v.df, v.label, "row_key", 0.2, 42)
    tr = sp.filter("not is_test and brand <> 0").withColumn("brand", F.col("brand") - 1)
    te = sp.filter("is_test").withColumn("unseen", F.col("brand") == 0).withColumn("brand", F.col("brand") - 1)
    cards = v.cards() | {"brand": v.cards()["brand"] - 1}
    edges = [("target", "brand"), ("target", "size_b"), ("brand", "size_b")]
    nodes = ["brand", "size_b", "target"]
    cpts = fit_cpts(tr, edges, nodes)
    return bn_map_predict(te, cpts, edges, nodes, "target", cards).select("row_key", "unseen", "pred")


# ------------------------------------------------------------------ missing values

_DOCS_SQL = "dl AS (SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _docs_labels(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(read(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@register("null_audit_labels", f"WITH {_DOCS_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM dl" for c in ("doc_id", "lang", "n_chars", "quality", "toxic")))
def q_null_audit_labels(spark, d):
    """P15 where values are missing: documents without a label."""
    return E.null_audit(_docs_labels(spark, d)).withColumnRenamed("column", "col_name")


@register("drop_null_labels", f"WITH {_DOCS_SQL} SELECT * FROM dl WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def q_drop_null_labels(spark, d):
    """Only the labelled documents stay."""
    return E.drop_null_rows(_docs_labels(spark, d))


@register("bind_and_align", f"WITH {_DOCS_SQL} SELECT doc_id AS row_key, lang, n_chars, quality AS target FROM dl WHERE quality IS NOT NULL")
def q_bind_and_align(spark, d):
    """P13 + P20 + P12: label split off, bound again by key, and aligned to the order of another table."""
    full = E.drop_null_rows(_docs_labels(spark, d)).withColumnRenamed("doc_id", "row_key").drop("toxic").withColumnRenamed("quality", "target")
    x, y, name = E.split_label(full.withColumn("extra", F.lit(1)), "target")
    keyed = full.select("row_key", name)
    bound = E.bind_columns(x, keyed)
    return E.align_columns(bound, full.select("target", "lang", "row_key", "n_chars"))[0]


@register("kl_loss", f"{_split_tables()}, p AS (SELECT target, count(*) * 1e0 / sum(count(*)) OVER () AS share FROM tr GROUP BY target) "
          "SELECT round(avg(-ln(1 - share)), 8) AS kl_loss FROM te JOIN p USING (target)")
def q_kl_loss(spark, d):
    """Mean of −ln(1 − p) over test rows, p the class prior of the train rows."""
    v, sp = _li_split(spark, d)
    prior = E.class_counts(sp.filter("not is_test"), "target").select("target", "share")
    return C.kl_loss(sp.filter("is_test").join(prior, "target"), "share").select(_r("kl_loss", 8).alias("kl_loss"))


# ------------------------------------------------------------------ a network with several parents

_NET = [("target", "qty_b"), ("target", "price_b"), ("qty_b", "price_b"), ("target", "disc_b"), ("price_b", "disc_b"), ("qty_b", "disc_b")]
_NET_NODES = ["qty_b", "price_b", "disc_b", "target"]
_NET_ORDER = ["target", "qty_b", "price_b", "disc_b"]
_NET_PARENTS = {"target": (), "qty_b": ("target",), "price_b": ("qty_b", "target"), "disc_b": ("qty_b", "price_b", "target")}


def _net_ctes(view: str = "li") -> str:
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    out = []
    for node, pa in _NET_PARENTS.items():
        part = f"PARTITION BY {', '.join(pa)} " if pa else ""
        keys = ", ".join([*pa, node])
        out.append(f"cpt_{node} AS (SELECT {keys}, n / sum(n) OVER ({part}) AS p, (sum(n) OVER ({part}ORDER BY {node} {run}) - n) / sum(n) OVER ({part}) AS lo, "
                   f"sum(n) OVER ({part}ORDER BY {node} {run}) / sum(n) OVER ({part}) AS hi FROM (SELECT {keys}, count(*) * 1e0 AS n FROM {view} GROUP BY {keys}))")
    return ", ".join(out)


def _net_sample() -> str:
    ctes = ["s0 AS (SELECT row_number() OVER () - 1 AS row_id FROM li)"]
    for i, node in enumerate(_NET_ORDER):
        u = O.ub_sql("s.row_id", _NET_NODES.index(node))
        pa = _NET_PARENTS[node]
        on = " AND ".join([*(f"c.{p} = s.{p}" for p in pa), f"{u} >= c.lo", f"{u} < c.hi"])
        card = 5 if node != "target" else 3
        ctes.append(f"s{i + 1} AS (SELECT s.*, coalesce(c.{node}, CAST(floor({u} * {card}) AS INTEGER)) AS {node} FROM s{i} s LEFT JOIN cpt_{node} c ON {on})")
    return ", ".join(ctes)


@register("fit_cpts_multi", f"WITH {O.view_cte('li')}, {_net_ctes()} " + " UNION ALL ".join(
    f"SELECT '{n}' AS child, " + ("concat_ws(',', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in pa) + ")" if pa else "''") +
    f" AS pa, {n} AS value, round(p, 6) AS p, round(lo, 6) AS cum_lo, round(hi, 6) AS cum_hi FROM cpt_{n}" for n, pa in _NET_PARENTS.items()))
def q_fit_cpts_multi(spark, d):
    """G1 with up to three parents."""
    cp = fit_cpts(_li(spark, d).df, _NET, _NET_NODES)
    return cp.select("child", F.array_join(F.col("pa").cast("array<string>"), ",").alias("pa"), "value",
                     _r("p").alias("p"), _r("cum_lo").alias("cum_lo"), _r("cum_hi").alias("cum_hi"))


@register("ancestral_sample_multi", f"WITH {O.view_cte('li')}, {_net_ctes()}, {_net_sample()} SELECT row_id, qty_b, price_b, disc_b, target FROM s4")
def q_sample_multi(spark, d):
    """G6 through packed keys of several parents."""
    v = _li(spark, d)
    cp = fit_cpts(v.df, _NET, _NET_NODES)
    return ancestral_sample(spark, cp, _NET, _NET_NODES, {n: v.cards()[n] for n in _NET_NODES}, v.df.count(), seed=42)


@register("bn_map_predict_multi", f"{_split_tables()}, {_net_ctes('tr')}, ys AS (SELECT DISTINCT target FROM tr), "
          "sc AS (SELECT te.row_key, ys.target AS y, round(ln(t.p) + CASE WHEN pq.target IS NULL THEN ln(0.2) ELSE coalesce(ln(q.p), -1e300) END "
          "+ CASE WHEN pp.target IS NULL THEN ln(0.2) ELSE coalesce(ln(r.p), -1e300) END + CASE WHEN pd.target IS NULL THEN ln(0.2) ELSE coalesce(ln(e.p), -1e300) END, 9) AS l "
          "FROM te CROSS JOIN ys JOIN cpt_target t ON t.target = ys.target "
          "LEFT JOIN (SELECT DISTINCT target FROM cpt_qty_b) pq ON pq.target = ys.target LEFT JOIN cpt_qty_b q ON q.target = ys.target AND q.qty_b = te.qty_b "
          "LEFT JOIN (SELECT DISTINCT target, qty_b FROM cpt_price_b) pp ON pp.target = ys.target AND pp.qty_b = te.qty_b "
          "LEFT JOIN cpt_price_b r ON r.target = ys.target AND r.qty_b = te.qty_b AND r.price_b = te.price_b "
          "LEFT JOIN (SELECT DISTINCT target, qty_b, price_b FROM cpt_disc_b) pd ON pd.target = ys.target AND pd.qty_b = te.qty_b AND pd.price_b = te.price_b "
          "LEFT JOIN cpt_disc_b e ON e.target = ys.target AND e.qty_b = te.qty_b AND e.price_b = te.price_b AND e.disc_b = te.disc_b) "
          "SELECT row_key, CASE WHEN max(l) <= -5e299 THEN NULL ELSE CAST(min(CASE WHEN l = m THEN y END) AS INTEGER) END AS pred FROM "
          "(SELECT *, max(l) OVER (PARTITION BY row_key) AS m FROM sc) GROUP BY row_key")
def q_map_multi(spark, d):
    """G11 through packed keys of several parents."""
    v, sp = _li_split(spark, d)
    cp = fit_cpts(sp.filter("not is_test"), _NET, _NET_NODES)
    return bn_map_predict(sp.filter("is_test"), cp, _NET, _NET_NODES, "target", v.cards()).select("row_key", "pred")


# ------------------------------------------------------------------ evaluation on a label that is a function of a feature

_TSTR_SQL = ("WITH c AS (SELECT n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
             "m AS (SELECT n_name, mode(r_name) AS r FROM c GROUP BY n_name), a AS (SELECT avg(CASE WHEN r = r_name THEN 1e0 ELSE 0e0 END) AS v FROM c JOIN m USING (n_name)) ")


def _customers(spark, d):
    """(train, test, cards): nation code and, as the label, region code of every customer."""
    v = model_view(spark, d, "cust")
    df = v.df.select("row_key", "nation", F.col("region").alias("target"))
    sp = SEL.stratified_split(df, "target", "row_key", 0.2, 42)
    cards = {"nation": v.cards()["nation"], "target": v.cards()["region"]}
    return sp.filter("not is_test"), sp.filter("is_test"), cards


def _tstr(spark, d, classifiers) -> DataFrame:
    from bayesloom.plans.models import BayesNetSynthesizer

    tr, te, cards = _customers(spark, d)
    model = BayesNetSynthesizer("naive").fit(tr, ["nation"], "target", cards)
    res = model.evaluate(te.select("nation", "target"), n=int(tr.count()), classifiers=classifiers)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in res.items() if isinstance(v, float)], "metric string, value double")


for _name in ("lr", "mlp", "rf", "xgb"):
    @register(f"tstr_{_name}", _TSTR_SQL + f"SELECT '{_name}' AS metric, v AS value FROM a UNION ALL SELECT 'avg', v FROM a")
    def _q_tstr(spark, d, name=_name):
        """V1–V6: trained on synthetic customers, tested on real ones; region follows from nation, so a right classifier makes no error."""
        from bayesloom.operators.evaluate import classifier

        # ten boosting rounds are enough for a rule of one feature; each round is a chain of Spark jobs
        return _tstr(spark, d, ((name, classifier(name, 5, 25, trees=10)) if name == "xgb" else name,))


# ------------------------------------------------------------------ mixtures of several modes

# fixed values: (weight, mean, deviation) of three modes on the min-max scaled quantity
_MODES = ((0.3, 0.15, 0.1), (0.45, 0.5, 0.2), (0.25, 0.85, 0.08))
_SCALED = "(CAST(l_quantity AS DOUBLE) - lo) / (hi - lo)"
_QTY = f"WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), sc AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, {_SCALED} AS x FROM lineitem, r)"


def _mode_sql() -> str:
    score = [f"ln({w!r}) - ln({s!r}) - 0.5 * power((x - {m!r}) / {s!r}, 2)" for w, m, s in _MODES]
    best = f"greatest({', '.join(score)})"
    mode = "CASE " + " ".join(f"WHEN {x} = {best} THEN {i}" for i, x in enumerate(score)) + " END"
    z = "CASE mode " + " ".join(f"WHEN {i} THEN (x - {m!r}) / {s!r}" for i, (_, m, s) in enumerate(_MODES)) + " END"
    bins = " + ".join(f"CAST({z} > {e} AS INTEGER)" for e in (-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0))
    return f"{_QTY}, md AS (SELECT *, {mode} AS mode FROM sc) SELECT row_key, CAST(mode * 8 + {bins} AS INTEGER) AS code FROM md"


@register("mixture_assign", _mode_sql())
def q_mixture_assign(spark, d):
    """M2 + M3 with three given modes."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    from bayesloom.operators.encode import MinMaxScaler
    li = read(spark, d, "lineitem").select(F.expr("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("row_key"), "l_quantity")
    w, m, s = ([x[i] for x in _MODES] for i in range(3))
    mix = MixtureDiscretiser(["l_quantity"], MinMaxScaler.fit(li, ["l_quantity"]), {"l_quantity": w}, {"l_quantity": m}, {"l_quantity": s})
    return mix.transform(li).select("row_key", F.col("l_quantity").cast("int").alias("code"))


def _modes_decode_sql() -> str:
    from bayesloom.operators.discretise import PHI_EDGES
    pick = lambda i: "CASE code // 8 " + " ".join(f"WHEN {j} THEN {m[i]!r}" for j, m in enumerate(_MODES)) + " END"
    edge = lambda o: "CASE code % 8 " + " ".join(f"WHEN {i} THEN {PHI_EDGES[i + o]!r}" for i in range(8)) + " END"
    u = O.u_sql("row_key", "l_quantity")
    return (f"WITH cd AS ({_mode_sql()}), pr AS (SELECT row_key, code, least(greatest(({edge(0)}) + (({edge(1)}) - ({edge(0)})) * {u}, 1e-15), {1 - 1e-15!r}) AS p FROM cd), "
            "q AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem) "
            f"SELECT row_key, round((({pick(1)}) + ({pick(2)}) * {O.probit('p')}) * (hi - lo) + lo, 4) AS l_quantity FROM pr, q")


@register("mixture_decode_modes", _modes_decode_sql())
def q_mixture_decode_modes(spark, d):
    """M4 + M5 with three given modes."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    from bayesloom.operators.encode import MinMaxScaler
    li = read(spark, d, "lineitem").select(F.expr("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("row_key"), "l_quantity")
    w, m, s = ([x[i] for x in _MODES] for i in range(3))
    mix = MixtureDiscretiser(["l_quantity"], MinMaxScaler.fit(li, ["l_quantity"]), {"l_quantity": w}, {"l_quantity": m}, {"l_quantity": s})
    return mix.inverse(mix.transform(li), "row_key", 42).select("row_key", _r("l_quantity", 4).alias("l_quantity"))


def _bds_moves_sql() -> str:
    nodes = ["nation", "region", "target"]
    fams = [("nation", ()), ("nation", ("target",)), ("region", ("target",)), ("region", ("nation", "target")), ("nation", ("region", "target")), ("region", ()),
            ("target", ()), ("target", ("nation",)), ("target", ("region",))]
    cards = {c: f"(SELECT count(DISTINCT {c}) FROM cust)" for c in nodes}
    b = lambda c, *ps: f"(SELECT bds FROM t WHERE family = '{c}|{','.join(ps)}')"
    rows = [("+|nation|region", f"{b('region', 'nation', 'target')} - {b('region', 'target')} - ln(2.0)"),
            ("+|region|nation", f"{b('nation', 'region', 'target')} - {b('nation', 'target')} - ln(2.0)")]
    for x in ("nation", "region"):
        rows.append((f"-|target|{x}", f"{b(x)} - {b(x, 'target')} + ln(2.0)"))
        rows.append((f"flip|target|{x}", f"{b(x)} + {b('target', x)} - {b(x, 'target')} - {b('target')}"))
    return f"WITH {O.view_cte('cust')}, t AS {O.family_terms_sql('cust', fams, cards)} " + " UNION ALL ".join(
        f"SELECT '{op}' AS op, round({x}, 4) + 0.0 AS delta" for op, x in rows)


@register("score_neighbours_bds", _bds_moves_sql())
def q_neighbours_bds(spark, d):
    """K8 + K10 + K11: all moves, removals too, under BDs with its prior over structures."""
    v, nodes = model_view(spark, d, "cust"), ["nation", "region", "target"]
    cache = K.FamilyScoreCache(v.df, nodes, v.cards(), "bds")
    start = [("target", "nation"), ("target", "region")]
    rows = [(K.op_sort_key(op), round(x, 4) + 0.0) for op, x in K.score_neighbours(cache, start, K.neighbours(start, nodes, allow_remove=True))]
    return spark.createDataFrame(rows, "op string, delta double")


def _em_sql(steps: int) -> str:
    ctes = [f"{_QTY}, v AS (SELECT x, count(*) * 1e0 AS w FROM sc GROUP BY x)",
            "p0 AS (SELECT 0.5 AS w1, 0.5 AS w2, quantile_disc(x, 0.25) AS m1, quantile_disc(x, 0.75) AS m2, greatest(stddev_pop(x) / 2, 1e-3) AS s1, greatest(stddev_pop(x) / 2, 1e-3) AS s2 FROM sc)"]
    for i in range(steps):
        d = lambda j: f"w{j} / s{j} * exp(-0.5 * power((x - m{j}) / s{j}, 2))"
        ctes.append(f"e{i} AS (SELECT x, v.w, {d(1)} / ({d(1)} + {d(2)}) AS r FROM v, p{i})")
        ctes.append(f"a{i} AS (SELECT sum(w) AS n, sum(w * r) AS n1, sum(w * (1 - r)) AS n2, sum(w * r * x) AS x1, sum(w * (1 - r) * x) AS x2, "
                    f"sum(w * r * x * x) AS q1, sum(w * (1 - r) * x * x) AS q2 FROM e{i})")
        ctes.append(f"p{i + 1} AS (SELECT n1 / n AS w1, n2 / n AS w2, x1 / n1 AS m1, x2 / n2 AS m2, "
                    f"sqrt(greatest(q1 / n1 - power(x1 / n1, 2), 0) + 1e-6) AS s1, sqrt(greatest(q2 / n2 - power(x2 / n2, 2), 0) + 1e-6) AS s2 FROM a{i})")
    return ", ".join(ctes) + (f" SELECT 0 AS mode, round(w1, 8) AS weight, round(m1, 8) AS mu, round(s1, 8) AS sigma FROM p{steps} "
                              f"UNION ALL SELECT 1, round(w2, 8), round(m2, 8), round(s2, 8) FROM p{steps}")


@register("mixture_two_steps", _em_sql(2))
def q_mixture_two_steps(spark, d):
    """M1: two EM steps of two modes from the start by quantiles of the rows."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    m = MixtureDiscretiser.fit(read(spark, d, "lineitem").select("l_quantity"), ["l_quantity"], k=2, max_iter=2, tol=0.0, method="em")
    rows = [(j, *(round(p["l_quantity"][j], 8) for p in (m.weights, m.mu, m.sigma))) for j in range(2)]
    return spark.createDataFrame(rows, "mode int, weight double, mu double, sigma double")


def _variational_sql(steps: int, gamma: float = 0.5, beta0: float = 0.1) -> str:
    """Two components, truncated stick-breaking: posterior after ``steps`` from the start by quantiles."""
    from bayesloom.functions import digamma_sql as psi
    ctes = [f"{_QTY}, v AS (SELECT x, count(*) * 1e0 AS w FROM sc GROUP BY x)", "base AS (SELECT avg(x) AS m0, greatest(var_samp(x), 1e-6) AS v0 FROM sc)",
            "p0 AS (SELECT ln(0.5) AS o1, ln(0.5) AS o2, quantile_disc(x, 0.25) AS m1, quantile_disc(x, 0.75) AS m2, "
            "greatest(stddev_pop(x) / 2, 1e-3) AS s1, greatest(stddev_pop(x) / 2, 1e-3) AS s2, 0.5 AS w1, 0.5 AS w2 FROM sc)"]
    for i in range(steps):
        log = lambda j: f"(o{j} - ln(s{j}) - 0.5 * power((x - m{j}) / s{j}, 2))"
        ctes.append(f"e{i} AS (SELECT x - m0 AS d, v.w, 1 / (1 + exp({log(2)} - {log(1)})) AS r FROM v, p{i}, base)")
        ctes.append(f"a{i} AS (SELECT sum(w * r) AS n1, sum(w * (1 - r)) AS n2, sum(w * r * d) AS x1, sum(w * (1 - r) * d) AS x2, "
                    f"sum(w * r * d * d) AS q1, sum(w * (1 - r) * d * d) AS q2 FROM e{i})")
        var = lambda j: (f"((v0 + greatest(q{j} - x{j} * x{j} / n{j}, 0) + n{j} * {beta0} / (n{j} + {beta0}) * power(x{j} / n{j}, 2)) / (n{j} + 1))")
        kernel = lambda j: f"- ln(n{j} + 1) / 2 + (ln(2.0) + {psi(f'((n{j} + 1) / 2)')} - 1 / (n{j} + {beta0})) / 2"
        in1, out1 = (f"({psi(f'({t})')} - {psi(f'(1 + n1 + {gamma} + n2)')})" for t in ("1 + n1", f"{gamma} + n2"))
        in2 = f"({psi('(1 + n2)')} - {psi(f'(1 + n2 + {gamma})')})"
        share = f"((1 + n1) / (1 + n1 + {gamma} + n2))"
        ctes.append(f"p{i + 1} AS (SELECT {in1} {kernel(1)} AS o1, {in2} + {out1} {kernel(2)} AS o2, m0 + x1 / (n1 + {beta0}) AS m1, m0 + x2 / (n2 + {beta0}) AS m2, "
                    f"sqrt({var(1)}) AS s1, sqrt({var(2)}) AS s2, {share} AS w1, (1 - {share}) * (1 + n2) / (1 + n2 + {gamma}) AS w2 FROM a{i}, base)")
    return ", ".join(ctes) + "".join(f" {'UNION ALL ' if j == 2 else ''}SELECT {j - 1} AS mode, round(w{j} / (w1 + w2), 8) AS weight, round(m{j}, 8) AS mu, "
                                     f"round(s{j}, 8) AS sigma FROM p{steps}" for j in (1, 2))


@register("mixture_variational_steps", _variational_sql(2))
def q_mixture_variational(spark, d):
    """M1: two steps of the Dirichlet-process mixture of two components, from the start by quantiles of the rows."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    m = MixtureDiscretiser.fit(read(spark, d, "lineitem").select("l_quantity"), ["l_quantity"], k=2, max_iter=2, tol=0.0)
    rows = [(j, *(round(p["l_quantity"][j], 8) for p in (m.weights, m.mu, m.sigma))) for j in range(2)]
    return spark.createDataFrame(rows, "mode int, weight double, mu double, sigma double")


# ------------------------------------------------------------------ views with dependence: customers and labelled documents

for _view in ("cust", "doc"):
    @register(f"{_view}_view", f"WITH {O.view_cte(_view)} SELECT * FROM {_view}")
    def _q_view(spark, d, view=_view):
        """P1 + P5 + P6: the coded view of a joined table."""
        return model_view(spark, d, view).df


_TREE = ["acctbal_b", "nation", "region", "target"]


def _tree_sql() -> str:
    pairs = O.pairs_sql("cust", [(a, b) for i, a in enumerate(_TREE) for b in _TREE[i + 1:]])
    ctes = [O.view_cte("cust"), f"ix AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n!r})' for i, n in enumerate(_TREE))}) t(i, n))",
            f"mi AS (SELECT split_part(fam, '|', 1) AS a, split_part(fam, '|', 2) AS b, round(sum(n / nn * ln(n * nn / (nx * ny))) / ln(2.0), 10) AS v FROM ("
            f"SELECT fam, n, sum(n) OVER (PARTITION BY fam, x) AS nx, sum(n) OVER (PARTITION BY fam, y) AS ny, sum(n) OVER (PARTITION BY fam) AS nn FROM ({pairs})) GROUP BY fam)",
            "e AS (SELECT a, b, v, p.i AS ia, q.i AS ib FROM (SELECT a, b, v FROM mi UNION ALL SELECT b, a, v FROM mi) JOIN ix p ON p.n = a JOIN ix q ON q.n = b)",
            "in0 AS (SELECT a AS n FROM e GROUP BY a, ia ORDER BY round(sum(v), 10) DESC, ia LIMIT 1)"]
    for k in range(1, len(_TREE)):
        ctes.append(f"s{k} AS (SELECT a, b FROM e WHERE a IN (SELECT n FROM in{k - 1}) AND b NOT IN (SELECT n FROM in{k - 1}) ORDER BY v DESC, ia, ib LIMIT 1)")
        ctes.append(f"in{k} AS (SELECT n FROM in{k - 1} UNION ALL SELECT b FROM s{k})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT a AS src, b AS dst FROM s{k}" for k in range(1, len(_TREE)))


@register("tree_search_customers", _tree_sql())
def q_tree_customers(spark, d):
    """Maximum spanning tree over pairwise information; nation decides region."""
    v = model_view(spark, d, "cust")
    return K.edges_df(spark, K.tree_search(v.df, _TREE))
