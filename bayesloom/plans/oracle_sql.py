"""Plain-SQL statements of the registered queries (run by DuckDB as an independent check).

Each statement recomputes its result from the raw driver tables; the Python here only
writes repetitive SQL (one UNION ALL branch per column or family).
"""

from __future__ import annotations

from bayesloom.functions.exprs import hash_uniform_block_sql, hash_uniform_sql, probit_sql
from bayesloom.sources.tables import SPEC

LI_FEATURES = ["qty_b", "price_b", "disc_b", "tax_b", "status"]
LABEL = "target"
LI_NODES = LI_FEATURES + [LABEL]
LN2 = "ln(2.0)"


def view_cte(name: str = "li") -> str:
    """CTE named ``name`` with the coded view (P5 bins, P1 codes) of a driver table."""
    spec = SPEC[name]
    src = {"li": "lineitem", "ord": "orders", "ev": "events", "prt": "part",
           "cust": "(SELECT c.*, n_name, r_name FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
           "doc": "(SELECT d.doc_id, lang, source, d.n_chars, quality FROM documents d JOIN labels USING (doc_id))"}[name]
    extra = {"ev": ", hour(ts) AS ev_hour"}.get(name, "")
    binned, coded = spec["binned"], spec["coded"]
    label, label_src = spec["label"]
    key = spec["key"].replace("STRING", "VARCHAR")
    stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in binned.values())
    cols = [f"{key} AS row_key"]
    for new, c in binned.items():
        x = f"CAST({c} AS DOUBLE)"
        terms = " + ".join(f"CAST({x} >= lo_{c} + {i} * ((hi_{c} - lo_{c}) / 5) AS INTEGER)" for i in range(1, 5))
        cols.append(f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE {terms} END AS {new}")
    for new, c in list(coded.items()) + [(label, label_src)]:
        cols.append(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {new}")
    return (f"{name}_src AS (SELECT *{extra} FROM {src}), {name}_st AS (SELECT {stats} FROM {name}_src), "
            f"{name} AS (SELECT {', '.join(cols)} FROM {name}_src, {name}_st)")


def u_sql(key: str, node: str, seed: int = 42) -> str:
    return hash_uniform_sql(f"CAST({key} AS VARCHAR)", f"'{node}'", f"'{seed}'", dialect="duckdb")


def ub_sql(key: str, i: int, seed: int = 42) -> str:
    """Uniform of the node at position ``i``: slot i % 4 of digest i // 4."""
    return hash_uniform_block_sql(f"CAST({key} AS VARCHAR)", i // 4, i % 4, seed, dialect="duckdb")


def split_cte(view: str = "li", frac: float = 0.2, seed: int = 42) -> str:
    """``split`` CTE: the view plus is_test."""
    u = u_sql("row_key", "split", seed)
    return (f"split_u AS (SELECT *, {u} AS u FROM {view}), "
            f"split AS (SELECT * EXCLUDE (u, rn, cnt), rn <= ceil(cnt * {frac}) AS is_test FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY u, row_key) AS rn, "
            f"count(*) OVER (PARTITION BY {LABEL}) AS cnt FROM split_u))")


def pairs_sql(view: str, fams: list[tuple[str, str]]) -> str:
    """(fam, x, y, n) of two-column families."""
    return " UNION ALL ".join(
        f"SELECT '{a}|{b}' AS fam, {a} AS x, {b} AS y, count(*) * 1e0 AS n FROM {view} GROUP BY {a}, {b}"
        for a, b in fams)


def mi_sql(view: str, feats: list[str], label: str) -> str:
    """(feature, mi) base 2 (unrounded)."""
    pairs = pairs_sql(view, [(f, label) for f in feats])
    return (f"SELECT split_part(fam, '|', 1) AS feature, sum(n / nn * ln(n * nn / (nx * ny))) / {LN2} AS mi FROM ("
            f"SELECT fam, n, sum(n) OVER (PARTITION BY fam, x) AS nx, sum(n) OVER (PARTITION BY fam, y) AS ny, "
            f"sum(n) OVER (PARTITION BY fam) AS nn FROM ({pairs})) GROUP BY fam")


def cmi_sql(view: str, feats: list[str], label: str) -> str:
    """(a, b, cmi) for a < b by position, base 2 (unrounded)."""
    trip = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS z, {label} AS y, count(*) * 1e0 AS n FROM {view} GROUP BY {a}, {b}, {label}"
        for i, a in enumerate(feats) for b in feats[i + 1:])
    return (f"SELECT a, b, sum(n / nn * ln(n * ny / (nxy * nzy))) / {LN2} AS cmi FROM ("
            f"SELECT a, b, n, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b, x, y) AS nxy, "
            f"sum(n) OVER (PARTITION BY a, b, z, y) AS nzy, sum(n) OVER (PARTITION BY a, b) AS nn FROM ({trip})) GROUP BY a, b")


def idx_sql(feats: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS idx" for i, f in enumerate(feats))


def kdb_sql(view: str, feats: list[str], label: str, k: int) -> str:
    """(src, dst) edges of the k-dependence structure (K1)."""
    return (
        f"WITH mi AS ({mi_sql(view, feats, label)}), ix AS ({idx_sql(feats)}), "
        f"rk AS (SELECT mi.feature, row_number() OVER (ORDER BY round(mi, 10) DESC, idx) - 1 AS r FROM mi JOIN ix USING (feature)), "
        f"c1 AS ({cmi_sql(view, feats, label)}), cm AS (SELECT a, b, cmi FROM c1 UNION ALL SELECT b, a, cmi FROM c1), "
        f"cand AS (SELECT c.feature AS child, p.feature AS parent, p.r AS pr, row_number() OVER ("
        f"PARTITION BY c.feature ORDER BY round(cm.cmi, 10) DESC, p.r) AS kk FROM rk c JOIN rk p ON p.r < c.r "
        f"JOIN cm ON cm.a = p.feature AND cm.b = c.feature) "
        f"SELECT '{label}' AS src, feature AS dst FROM rk UNION ALL SELECT parent AS src, child AS dst FROM cand WHERE kk <= {k}")


def local_terms_sql(view: str, fams: list[tuple[str, tuple]], cards: dict, n_rows_sql: str, ess: float = 10.0) -> str:
    """(family, ll, bic, aic, k2, bdeu, bds) for families (child, parents)."""
    parts = []
    for child, pa in fams:
        name = child + "|" + ",".join(pa)
        gb = ", ".join([child, *pa])
        pa_key = "concat_ws(',', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in pa) + ")" if pa else "''"
        q = 1.0
        for p in pa:
            q *= cards[p]
        parts.append(f"SELECT '{name}' AS family, {pa_key} AS pa, count(*) * 1e0 AS n, {float(cards[child])} AS r, {q} AS q "
                     f"FROM {view} GROUP BY {gb}")
    cells = " UNION ALL ".join(parts)
    return (
        f"WITH cells AS ({cells}), qo AS (SELECT family, count(DISTINCT pa) * 1e0 AS q_obs FROM cells GROUP BY family), "
        f"c2 AS (SELECT c.*, q_obs FROM cells c JOIN qo USING (family)), "
        f"lv AS (SELECT family, pa, r, q, q_obs, sum(n) AS n_pa, sum(n * ln(n)) AS nlnn, sum(lgamma(n + 1)) AS lg1, "
        f"sum(lgamma(n + {ess} / (r * q)) - lgamma({ess} / (r * q))) AS lgb, "
        f"sum(lgamma(n + {ess} / (r * q_obs)) - lgamma({ess} / (r * q_obs))) AS lgs FROM c2 GROUP BY family, pa, r, q, q_obs), "
        f"fm AS (SELECT family, r, q, sum(nlnn - n_pa * ln(n_pa)) AS ll, sum(lgamma(r) - lgamma(n_pa + r) + lg1) AS k2, "
        f"sum(lgamma({ess} / q) - lgamma(n_pa + {ess} / q) + lgb) AS bdeu, "
        f"sum(lgamma({ess} / q_obs) - lgamma(n_pa + {ess} / q_obs) + lgs) AS bds FROM lv GROUP BY family, r, q) "
        f"SELECT family, ll, ll - 0.5 * ln(({n_rows_sql}) * 1e0) * q * (r - 1) AS bic, ll - q * (r - 1) AS aic, k2, bdeu, bds FROM fm")


def probit(u: str) -> str:
    return probit_sql(u)


def li_cards_sql(view: str = "li") -> dict:
    """Domain size SQL per node: 5 for binned columns, distinct count for coded ones."""
    return {"qty_b": "5", "price_b": "5", "disc_b": "5", "tax_b": "5",
            "status": f"(SELECT count(DISTINCT status) FROM {view})", "target": f"(SELECT count(DISTINCT target) FROM {view})"}


def family_terms_sql(view: str, fams: list[tuple[str, tuple]], cards: dict, ess: float = 10.0) -> str:
    """(family, ll, bic, aic, k2, bdeu, bds) for families (child, parents); cards are SQL expressions."""
    parts = []
    for child, pa in fams:
        name = child + "|" + ",".join(pa)
        gb = ", ".join([child, *pa])
        pa_key = ("concat_ws(',', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in pa) + ")") if pa else "''"
        q = " * ".join(f"({cards[p]})" for p in pa) if pa else "1"
        parts.append(f"SELECT '{name}' AS family, {pa_key} AS pa, count(*) * 1e0 AS n, ({cards[child]}) * 1e0 AS r, ({q}) * 1e0 AS q "
                     f"FROM {view} GROUP BY {gb}")
    cells = " UNION ALL ".join(parts)
    return (
        f"(WITH cells AS ({cells}), qo AS (SELECT family, count(DISTINCT pa) * 1e0 AS q_obs FROM cells GROUP BY family), "
        f"c2 AS (SELECT c.*, q_obs FROM cells c JOIN qo USING (family)), "
        f"lv AS (SELECT family, pa, r, q, q_obs, sum(n) AS n_pa, sum(n * ln(n)) AS nlnn, sum(lgamma(n + 1)) AS lg1, "
        f"sum(lgamma(n + {ess} / (r * q)) - lgamma({ess} / (r * q))) AS lgb, "
        f"sum(lgamma(n + {ess} / (r * q_obs)) - lgamma({ess} / (r * q_obs))) AS lgs FROM c2 GROUP BY family, pa, r, q, q_obs), "
        f"fm AS (SELECT family, r, q, sum(nlnn - n_pa * ln(n_pa)) AS ll, sum(lgamma(r) - lgamma(n_pa + r) + lg1) AS k2, "
        f"sum(lgamma({ess} / q) - lgamma(n_pa + {ess} / q) + lgb) AS bdeu, "
        f"sum(lgamma({ess} / q_obs) - lgamma(n_pa + {ess} / q_obs) + lgs) AS bds FROM lv GROUP BY family, r, q) "
        f"SELECT family, ll, ll - 0.5 * ln((SELECT count(*) FROM {view}) * 1e0) * q * (r - 1) AS bic, ll - q * (r - 1) AS aic, "
        f"k2, bdeu, bds FROM fm)")


def naive_cpt_ctes(view: str, feats: list[str], label: str, prefix: str = "cpt") -> str:
    """CPT CTEs of the naive structure: {prefix}_{label}(value, lo, hi) and {prefix}_{f}(p0, value, lo, hi)."""
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    out = [f"{prefix}_{label} AS (SELECT value, n, (sum(n) OVER (ORDER BY value {run}) - n) / sum(n) OVER () AS lo, "
           f"sum(n) OVER (ORDER BY value {run}) / sum(n) OVER () AS hi FROM "
           f"(SELECT {label} AS value, count(*) * 1e0 AS n FROM {view} GROUP BY {label}))"]
    for f in feats:
        w = f"PARTITION BY p0 ORDER BY value {run}"
        out.append(f"{prefix}_{f} AS (SELECT p0, value, n, (sum(n) OVER ({w}) - n) / sum(n) OVER (PARTITION BY p0) AS lo, "
                   f"sum(n) OVER ({w}) / sum(n) OVER (PARTITION BY p0) AS hi FROM "
                   f"(SELECT {label} AS p0, {f} AS value, count(*) * 1e0 AS n FROM {view} GROUP BY {label}, {f}))")
    return ", ".join(out)


def naive_sample_ctes(view: str, feats: list[str], label: str, seed: int = 42, out: str = "sample",
                      prefix: str = "cpt", cards: dict | None = None) -> str:
    """Ancestral sample of N = |view| rows from the naive structure (label first, then features)."""
    nodes = list(feats) + [label]
    ut = ub_sql("s.row_id", nodes.index(label), seed)
    ctes = [naive_cpt_ctes(view, feats, label, prefix),
            f"{out}_0 AS (SELECT row_number() OVER () - 1 AS row_id FROM {view})",
            f"{out}_1 AS (SELECT s.row_id, c.value AS {label} FROM {out}_0 s JOIN {prefix}_{label} c "
            f"ON {ut} >= c.lo AND {ut} < c.hi)"]
    prev = f"{out}_1"
    for i, f in enumerate(feats):
        cur = f"{out}_{i + 2}"
        u = ub_sql("s.row_id", nodes.index(f), seed)
        card = (cards or li_cards_sql(view))[f]
        ctes.append(f"{cur} AS (SELECT s.*, coalesce(c.value, CAST(floor({u} * {card}) AS INTEGER)) AS {f} FROM {prev} s "
                    f"LEFT JOIN {prefix}_{f} c ON c.p0 = s.{label} AND {u} >= c.lo AND {u} < c.hi)")
        prev = cur
    ctes.append(f"{out} AS (SELECT row_id, {', '.join(feats)}, {label} FROM {prev})")
    return ", ".join(ctes)


def naive_map_ctes(train: str, test: str, feats: list[str], label: str, out: str = "pred") -> str:
    """MAP label of each test row under the naive structure fitted on ``train`` → out(row_key, pred)."""
    pf = " UNION ALL ".join(
        f"SELECT '{f}' AS f, {f} AS v, {label} AS y, ln(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY {label})) AS lp "
        f"FROM {train} GROUP BY {f}, {label}" for f in feats)
    tl = " UNION ALL ".join(f"SELECT row_key, '{f}' AS f, {f} AS v FROM {test}" for f in feats)
    return (
        f"{out}_py AS (SELECT {label} AS y, ln(count(*) * 1e0 / (SELECT count(*) FROM {train})) AS lp FROM {train} GROUP BY {label}), "
        f"{out}_pf AS ({pf}), {out}_tl AS ({tl}), "
        f"{out}_sc AS (SELECT tl.row_key, py.y, round(any_value(py.lp) + sum(pf.lp), 9) AS s, count(pf.lp) AS k FROM {out}_tl tl "
        f"CROSS JOIN {out}_py py LEFT JOIN {out}_pf pf ON pf.f = tl.f AND pf.v = tl.v AND pf.y = py.y GROUP BY tl.row_key, py.y), "
        f"{out}_best AS (SELECT row_key, y FROM (SELECT row_key, y, row_number() OVER (PARTITION BY row_key ORDER BY s DESC, y) AS rn "
        f"FROM {out}_sc WHERE k = {len(feats)}) WHERE rn = 1), "
        f"{out} AS (SELECT t.row_key, CAST(b.y AS INTEGER) AS pred FROM {test} t LEFT JOIN {out}_best b USING (row_key))")
