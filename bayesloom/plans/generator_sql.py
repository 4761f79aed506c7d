"""The discriminative k-dependence generator (K1, K3–K5, G3, G4, G6) in plain SQL, for the independent check: structure, count
initialisation, every gradient epoch with its projection, the CPTs and a sample, all in long form.
"""

from __future__ import annotations

from bayesloom.plans import oracle_sql as O


def generator_ctes(view: str, feats: list[str], label: str, k: int = 2, epochs: int = 5, lr: float = 1.0, smoothing: float = 1.0) -> str:
    """CTEs from the view on; ``cpt`` (child, cfg, y, value, p) are the features' rows and ``prior`` (y, p) the label's."""
    cols = ", ".join(feats)
    long = " UNION ALL ".join(f"SELECT rid, '{f}' AS feature, {i} AS pos, {f} AS v FROM base" for i, f in enumerate(feats))

    def projected(source: str) -> str:
        return (f"SELECT child, cfg, value, y, lw - m - ln(sum(exp(lw - m)) OVER (PARTITION BY child, cfg, y)) AS lw FROM "
                f"(SELECT *, max(lw) OVER (PARTITION BY child, cfg, y) AS m FROM ({source}))")

    ctes = [
        f"kdb AS MATERIALIZED (SELECT * FROM ({O.kdb_sql(view, feats, label, k)}))",
        f"base AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM (SELECT {cols}, {label} AS y, count(*) * 1e0 AS w FROM {view} GROUP BY {cols}, {label}))",
        f"long AS MATERIALIZED ({long})",
        f"par AS MATERIALIZED (SELECT dst AS child, src AS parent, idx AS pos FROM kdb JOIN ({O.idx_sql(feats)}) ON feature = src)",
        "code AS MATERIALIZED (SELECT l.rid, l.feature AS child, l.v AS value, coalesce(string_agg(p.v::VARCHAR, ',' ORDER BY q.pos), '') AS cfg "
        "FROM long l LEFT JOIN par q ON q.child = l.feature LEFT JOIN long p ON p.rid = l.rid AND p.feature = q.parent GROUP BY 1, 2, 3)",
        "total AS (SELECT sum(w) AS n FROM base)",
        "bias0 AS MATERIALIZED (SELECT y, ln(sum(w) / any_value(n)) AS bias FROM base, total GROUP BY y)",
        "seen AS (SELECT child, cfg, value, y, sum(w) AS n FROM code JOIN base USING (rid) GROUP BY ALL)",
        "w0 AS MATERIALIZED (" + projected(
            f"SELECT v.child, v.cfg, v.value, c.y, ln({smoothing} + coalesce(s.n, 0)) AS lw FROM (SELECT DISTINCT child, cfg, value FROM code) v "
            "CROSS JOIN (SELECT DISTINCT y FROM base) c LEFT JOIN seen s ON s.child = v.child AND s.cfg = v.cfg AND s.value = v.value AND s.y = c.y") + ")",
    ]
    for t in range(epochs):
        ctes += [
            f"l{t} AS (SELECT c.rid, w.y, any_value(b.bias) + sum(w.lw) AS l FROM code c JOIN w{t} w ON w.child = c.child AND w.cfg = c.cfg AND w.value = c.value "
            f"JOIN bias{t} b ON b.y = w.y GROUP BY c.rid, w.y)",
            f"r{t} AS MATERIALIZED (SELECT rid, s.y, b.w * (CASE WHEN b.y = s.y THEN 1e0 ELSE 0e0 END - e / sum(e) OVER (PARTITION BY rid)) / n AS r FROM "
            f"(SELECT rid, y, exp(l - max(l) OVER (PARTITION BY rid)) AS e FROM l{t}) s JOIN base b USING (rid), total)",
            f"g{t} AS (SELECT child, cfg, value, r.y, sum(r) AS g FROM code JOIN r{t} r USING (rid) GROUP BY ALL)",
            f"w{t + 1} AS MATERIALIZED (" + projected(f"SELECT child, cfg, value, y, lw + {lr} * coalesce(g, 0) AS lw FROM w{t} LEFT JOIN g{t} USING (child, cfg, value, y)") + ")",
            f"bias{t + 1} AS MATERIALIZED (SELECT y, any_value(bias) + {lr} * sum(r) AS bias FROM bias{t} JOIN r{t} USING (y) GROUP BY y)",
        ]
    ctes += [f"cpt AS MATERIALIZED (SELECT child, cfg, y, value, exp(lw) / sum(exp(lw)) OVER (PARTITION BY child, cfg, y) AS p FROM w{epochs})",
             f"prior AS MATERIALIZED (SELECT y, exp(bias) / sum(exp(bias)) OVER () AS p FROM bias{epochs})"]
    return ", ".join(ctes)


def generator_cpts(view: str, feats: list[str], label: str, **kw) -> str:
    return (f"WITH {O.view_cte(view)}, {generator_ctes(view, feats, label, **kw)} "
            "SELECT child, CASE WHEN cfg = '' THEN '' ELSE cfg || ',' END || y AS pa, value, round(p, 6) AS p FROM cpt "
            f"UNION ALL SELECT '{label}', '', y, round(p, 6) FROM prior")


def generator_sample(view: str, feats: list[str], label: str, seed: int = 42, cards: dict | None = None, **kw) -> str:
    nodes, cards = [*feats, label], cards or O.li_cards_sql(view)
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def intervals(source: str, keys: str, value: str) -> str:
        part = f"PARTITION BY {keys} " if keys else ""
        return (f"SELECT *, sum(p) OVER ({part}ORDER BY {value} {run}) / sum(p) OVER ({part}) AS hi, "
                f"(sum(p) OVER ({part}ORDER BY {value} {run}) - p) / sum(p) OVER ({part}) AS lo, "
                f"row_number() OVER ({part}ORDER BY {value} DESC) = 1 AS top FROM {source}")

    u = "CASE feature " + " ".join(f"WHEN '{f}' THEN {O.ub_sql('row_id', nodes.index(f), seed)}" for f in feats) + " END"
    card = "CASE feature " + " ".join(f"WHEN '{f}' THEN {cards[f]}" for f in feats) + " END"
    ctes = [
        f"rk AS (SELECT mi.feature, row_number() OVER (ORDER BY round(mi, 10) DESC, idx) - 1 AS r FROM ({O.mi_sql(view, feats, label)}) mi "
        f"JOIN ({O.idx_sql(feats)}) USING (feature))",
        f"cpti AS MATERIALIZED ({intervals('cpt', 'child, cfg, y', 'value')})",
        f"priori AS MATERIALIZED ({intervals('prior', '', 'y')})",
        f"sy AS MATERIALIZED (SELECT row_id, y FROM (SELECT row_number() OVER () - 1 AS row_id FROM {view}) JOIN priori ON "
        f"{O.ub_sql('row_id', len(feats), seed)} >= lo AND ({O.ub_sql('row_id', len(feats), seed)} < hi OR top))",
        "d0 AS (SELECT 0::BIGINT AS row_id, '' AS feature, 0 AS v WHERE false)",
    ]
    for r in range(len(feats)):
        ctes.append(
            f"d{r + 1} AS MATERIALIZED (SELECT * FROM d{r} UNION ALL SELECT row_id, feature, coalesce(c.value, floor(u * {card})::INTEGER) FROM "
            f"(SELECT row_id, y, feature, cfg, {u} AS u FROM (SELECT s.row_id, s.y, k.feature, coalesce(string_agg(d.v::VARCHAR, ',' ORDER BY q.pos), '') AS cfg "
            f"FROM sy s JOIN rk k ON k.r = {r} LEFT JOIN par q ON q.child = k.feature LEFT JOIN d{r} d ON d.row_id = s.row_id AND d.feature = q.parent "
            f"GROUP BY 1, 2, 3)) x LEFT JOIN cpti c ON c.child = x.feature AND c.cfg = x.cfg AND c.y = x.y AND u >= c.lo AND (u < c.hi OR c.top))")
    pivot = ", ".join(f"max(CASE WHEN feature = '{f}' THEN v END) AS {f}" for f in feats)
    return (f"WITH {O.view_cte(view)}, {generator_ctes(view, feats, label, **kw)}, {', '.join(ctes)} "
            f"SELECT row_id, {pivot}, any_value(y) AS {label} FROM d{len(feats)} JOIN sy USING (row_id) GROUP BY row_id")
