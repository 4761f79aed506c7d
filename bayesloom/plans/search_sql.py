"""The hybrid search over a network of three nodes in plain SQL, for the independent check: all DAGs over the nodes with their
scores and moves as tables, then one common table expression per step of all episodes.
"""

from __future__ import annotations

import hashlib
import itertools

from bayesloom.plans import oracle_sql as O


def _text(edges) -> str:
    return ";".join(sorted(f"{s}>{t}" for s, t in edges))


def _dags(nodes: list[str]) -> list[frozenset]:
    pairs = list(itertools.combinations(nodes, 2))
    out = []
    for way in itertools.product((0, 1, 2), repeat=len(pairs)):
        edges = frozenset((a, b) if w == 1 else (b, a) for (a, b), w in zip(pairs, way) if w)
        if any(all(order.index(s) < order.index(t) for s, t in edges) for order in itertools.permutations(nodes)):
            out.append(edges)
    return out


def _uniform(what: str, seed: int) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', episode, epoch, '{what}')), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _graph(nodes: list[str], view: str) -> tuple[dict, list[str]]:
    """Keys of all DAGs, and CTEs: dag (state, edges, score) and move (state, action, after, delta, score)."""
    dags = _dags(nodes)
    key = {g: hashlib.sha256(_text(g).encode()).hexdigest() for g in dags}
    families = sorted({(c, tuple(p for p in nodes if (p, c) in g)) for g in dags for c in nodes})
    name = lambda c, ps: c + "|" + ",".join(ps)
    cards = {c: f"(SELECT count(DISTINCT {c}) FROM {view})" for c in nodes}
    member = ", ".join(f"('{key[g]}', '{_text(g)}', '{name(c, tuple(p for p in nodes if (p, c) in g))}')" for g in dags for c in nodes)
    moves = []
    for g in dags:
        for x, y in itertools.permutations(nodes, 2):
            if (x, y) not in g and (y, x) not in g and g | {(x, y)} in dags:
                moves.append((g, f"+|{x}|{y}", g | {(x, y)}))
            if (x, y) in g and g - {(x, y)} | {(y, x)} in dags:
                moves.append((g, f"flip|{x}|{y}", g - {(x, y)} | {(y, x)}))
    move = ", ".join(f"('{key[g]}', '{a}', '{key[frozenset(h)]}')" for g, a, h in moves)
    return key, [
        O.view_cte(view),
        f"fam AS {O.family_terms_sql(view, families, cards)}",
        f"part(state, edges, family) AS (VALUES {member})",
        "dag AS (SELECT state, edges, sum(bic) AS score FROM part JOIN fam USING (family) GROUP BY state, edges)",
        f"move0(state, action, after) AS (VALUES {move})",
        "move AS (SELECT m.*, h.score - g.score AS delta, h.score AS score FROM move0 m JOIN dag g ON g.state = m.state JOIN dag h ON h.state = m.after)",
    ]


def hill_climb(nodes: list[str], view: str = "cust", steps: int = 12) -> str:
    """Edges (src, dst) of the best moves from the empty graph until none gains; ``steps`` of them at most, which three nodes never need."""
    key, ctes = _graph(nodes, view)
    ctes.append(f"s0 AS (SELECT '{key[frozenset()]}' AS state, []::VARCHAR[] AS tabu)")
    for i in range(steps):
        ctes.append(f"s{i + 1} AS (SELECT coalesce(m.after, s.state) AS state, CASE WHEN m.action LIKE 'flip%' THEN list_append(s.tabu, m.action) ELSE s.tabu END AS tabu "
                    f"FROM s{i} s LEFT JOIN (SELECT m.* FROM move m JOIN s{i} s ON m.state = s.state WHERE NOT list_contains(s.tabu, m.action) AND NOT list_contains(s.tabu, "
                    "'flip|' || split_part(m.action, '|', 3) || '|' || split_part(m.action, '|', 2)) "
                    "ORDER BY round(delta, 9) DESC, action LIMIT 1) m ON m.delta >= 1e-4)")
    return ("WITH " + ", ".join(ctes) + " SELECT split_part(e, '>', 1) AS src, split_part(e, '>', 2) AS dst FROM "
            f"(SELECT unnest(string_split(edges, ';')) AS e FROM dag JOIN s{steps} USING (state) WHERE edges <> '')")


def hybrid_search(features: list[str], label: str, episodes: int, epochs: int, n: int, epsilon: float, gamma: float = 0.9, alpha: float = 0.1,
                  beta: float = 0.9, seed: int = 42, view: str = "cust") -> str:
    """WITH clause whose tables are log, qs and ps (snapshots of Q and policy) and reached (every structure)."""
    nodes = [*features, label]
    key, ctes = _graph(nodes, view)
    naive = key[frozenset((label, f) for f in features)]
    a, b = features
    ctes += [
        f"mi AS ({O.mi_sql(view, features, label)})",
        # the one candidate edge from the feature of lower rank to the one of higher rank
        f"cand AS (SELECT CASE WHEN round((SELECT mi FROM mi WHERE feature = '{a}'), 10) >= round((SELECT mi FROM mi WHERE feature = '{b}'), 10) "
        f"THEN '+|{b}|{a}' ELSE '+|{a}|{b}' END AS action)",
        f"penalty AS (SELECT {len(nodes)} / 2.0 * ln(count(*)) AS penalty FROM {view})",
        f"e0 AS (SELECT i AS episode, -1 AS epoch, -1 AS step, '{naive}' AS state, []::VARCHAR[] AS tabu FROM range({episodes}) r(i))",
        "q0 AS (SELECT 0 AS episode, '' AS state, '' AS action, 0e0 AS q WHERE false)",
        "p0 AS (SELECT 0 AS episode, '' AS state, '' AS action, 0e0 AS value WHERE false)",
    ]
    now, step, logs = "e0", 0, []
    for epoch in range(epochs):
        mine = []
        for _ in range(n):
            step += 1
            ctes.append(
                f"g{step} AS (SELECT e.episode, m.action, m.after, m.delta, row_number() OVER (PARTITION BY e.episode ORDER BY round(m.delta, 9) DESC, m.action) AS r "
                f"FROM {now} e JOIN move m ON m.state = e.state WHERE NOT list_contains(e.tabu, m.action) AND NOT list_contains(e.tabu, "
                f"'flip|' || split_part(m.action, '|', 3) || '|' || split_part(m.action, '|', 2)))")
            ctes.append(
                f"l{step} AS (SELECT e.episode, {epoch} AS epoch, {step - 1} AS step, e.state, coalesce(g.action, 'none') AS action, "
                f"coalesce(g.after, e.state) AS after, coalesce(g.delta, 0) - penalty AS reward, CASE WHEN g.action LIKE 'flip%' THEN list_append(e.tabu, g.action) "
                f"ELSE e.tabu END AS tabu FROM {now} e CROSS JOIN penalty LEFT JOIN g{step} g ON g.episode = e.episode AND g.r = 1 AND g.delta >= 1e-4)")
            ctes.append(f"e{step} AS (SELECT episode, epoch, step, after AS state, tabu FROM l{step})")
            now = f"e{step}"
            mine.append(step)
        step += 1
        ctes.append(f"d{step} AS (SELECT episode, {epoch} AS epoch, state, tabu, {_uniform('policy', seed)} AS dice, {_uniform('pick', seed)} AS pick "
                    f"FROM (SELECT episode, {epoch} AS epoch, state, tabu FROM {now}))")
        ctes.append(f"o{step} AS (SELECT d.episode, m.action, m.after, m.delta, row_number() OVER (PARTITION BY d.episode ORDER BY m.action) - 1 AS i, "
                    f"count(*) OVER (PARTITION BY d.episode) AS n, dice, pick, c.action AS cand, p.value FROM d{step} d JOIN move m ON m.state = d.state "
                    f"LEFT JOIN cand c ON c.action = m.action LEFT JOIN p{epoch} p ON p.episode = d.episode AND p.state = d.state AND p.action = m.action AND p.value >= 0)")
        ctes.append(f"b{step} AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY CASE "
                    f"WHEN dice < {epsilon} AND cand IS NOT NULL THEN 0 ELSE 1 END, value DESC NULLS LAST, "
                    f"CASE WHEN value IS NULL THEN (CASE WHEN i = floor(pick * n) THEN 0 ELSE 1 END) END, action) AS r FROM o{step})")
        ctes.append(f"l{step} AS (SELECT d.episode, {epoch} AS epoch, {step - 1} AS step, d.state, coalesce(b.action, 'none') AS action, "
                    f"coalesce(b.after, d.state) AS after, coalesce(b.delta, 0) - penalty AS reward, d.tabu FROM d{step} d CROSS JOIN penalty "
                    f"LEFT JOIN b{step} b ON b.episode = d.episode AND b.r = 1)")
        ctes.append(f"e{step} AS (SELECT episode, epoch, step, after AS state, tabu FROM l{step})")
        now = f"e{step}"
        mine.append(step)
        logs += mine
        buffer = " UNION ALL ".join(f"SELECT *, {i} AS i FROM l{k}" for i, k in enumerate(mine))
        ctes.append(f"buf{epoch} AS ({buffer})")
        ctes.append(f"g_{epoch} AS (SELECT episode, sum(reward * power({gamma}, i)) AS g, arg_max(state, i) AS state, arg_max(action, i) AS action FROM buf{epoch} GROUP BY episode)")
        ctes.append(f"q{epoch + 1} AS (SELECT coalesce(q.episode, g.episode) AS episode, coalesce(q.state, g.state) AS state, coalesce(q.action, g.action) AS action, "
                    f"CASE WHEN g.g IS NULL THEN q.q ELSE coalesce(q.q, 0) + {alpha} * (g.g - coalesce(q.q, 0)) END AS q FROM q{epoch} q "
                    f"FULL JOIN g_{epoch} g ON q.episode = g.episode AND q.state = g.state AND q.action = g.action)")
        ctes.append(f"w{epoch} AS (SELECT f.episode, f.state, f.action, {beta} * f.reward + (1 - {beta}) * q.q AS value FROM (SELECT episode, state, action, "
                    f"arg_min(reward, i) AS reward FROM buf{epoch} GROUP BY episode, state, action) f JOIN q{epoch + 1} q USING (episode, state, action))")
        ctes.append(f"p{epoch + 1} AS (SELECT * FROM w{epoch} UNION ALL SELECT p.* FROM p{epoch} p ANTI JOIN w{epoch} w USING (episode, state, action))")
    ctes.append("log AS (" + " UNION ALL ".join(
        f"SELECT episode::INTEGER AS episode, epoch, step, state AS state_key, action, reward, after AS next_state_key FROM l{k}" for k in logs) + ")")
    ctes.append("qs AS (" + " UNION ALL ".join(f"SELECT state AS state_key, action, q FROM q{e + 1}" for e in range(epochs)) + ")")
    ctes.append("ps AS (" + " UNION ALL ".join(f"SELECT state AS state_key, action, value FROM p{e + 1}" for e in range(epochs)) + ")")
    ctes.append(f"reached AS (SELECT state AS state_key, edges, score FROM dag WHERE state IN (SELECT next_state_key FROM log) OR state = '{naive}')")
    return "WITH " + ", ".join(ctes) + " "
