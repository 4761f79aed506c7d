"""Structure learning.

Graphs are edge lists on the driver (O(columns²)); every number that decides an edge
(MI, CMI, family scores, Δ of a move) is computed by a Spark aggregation over the
data — one job per decision step, however many candidates it scores.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.functions import pack_codes
from bayesloom.operators.counts import _cmi_from_triples, _mi_from_pairs, family_counts
from bayesloom.operators.scores import gaussian_family_score, local_scores, parent_sets, structure_prior_ratio

Edge = tuple  # (src, dst)
Op = tuple    # (kind, (src, dst)) with kind in '+', '-', 'flip'


# ---------------------------------------------------------------- k-dependence structure


def mi_cmi(df: DataFrame, features: Sequence[str], label: str, base: float = 2.0, weight=None,
           compacted: bool = False, digits: int = 10) -> tuple[dict, dict]:
    """MI(x; y) per feature and CMI(a; b | y) per unordered pair, in ONE family-count job."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    from bayesloom.session import cached

    fams = [(f, (label,)) for f in features] + [(a, (b, label)) for a, b in pairs]
    ct = cached(family_counts(df, fams, weight, compacted))  # model-sized, read twice
    nf = len(features)
    mi = _mi_from_pairs(ct.filter(F.col("fam") < nf), base).collect()
    cmi = _cmi_from_triples(ct.filter(F.col("fam") >= nf), base).collect() if pairs else []
    ct.unpersist()
    mi_d = {features[r["fam"]]: round(r["mi"], digits) for r in mi}
    cmi_d = {}
    for r in cmi:
        a, b = pairs[r["fam"] - nf]
        cmi_d[(a, b)] = cmi_d[(b, a)] = round(r["cmi"], digits)
    return mi_d, cmi_d


def mi_order(mi: dict, features: Sequence[str]) -> list[str]:
    """C8 order: MI descending, ties by feature position."""
    pos = {f: i for i, f in enumerate(features)}
    return sorted(features, key=lambda f: (-mi.get(f, 0.0), pos[f]))


def kdb_edges(mi: dict, cmi: dict, features: Sequence[str], label: str, k: int) -> list[Edge]:
    """K1 from MI/CMI: label → every feature; each feature takes up to k parents among the
    features ranked before it, by CMI descending (ties by rank). k = 0 is naive Bayes."""
    order = mi_order(mi, features)
    edges = []
    for i, child in enumerate(order):
        edges.append((label, child))
        earlier = order[:i]
        chosen = sorted(earlier, key=lambda p: (-cmi.get((p, child), 0.0), order.index(p)))[:k]
        for p in sorted(chosen, key=order.index):
            edges.append((p, child))
    return edges


def kdb_structure(df: DataFrame, features: Sequence[str], label: str, k: int = 2, **kw) -> list[Edge]:
    """K1: k-dependence Bayesian structure."""
    mi, cmi = mi_cmi(df, features, label, **kw)
    return kdb_edges(mi, cmi, features, label, k)


def parents_without_label(edges: Sequence[Edge], label: str, features: Sequence[str]) -> dict[str, list[str]]:
    """K2: feature parents of each feature; several parents are ordered by feature position."""
    pos = {f: i for i, f in enumerate(features)}
    out = {f: [] for f in features}
    for s, t in edges:
        if s != label and t in out:
            out[t].append(s)
    return {f: sorted(ps, key=lambda p: (pos.get(p, len(pos)), p)) for f, ps in out.items()}


def naive_structure(features: Sequence[str], label: str) -> list[Edge]:
    """K6: label → every feature."""
    return [(label, f) for f in features]


def edges_df(spark, edges: Sequence[Edge]) -> DataFrame:
    return spark.createDataFrame([(s, t) for s, t in edges], "src string, dst string")


# ---------------------------------------------------------------- high-order features


def radix_code_expr(child: str, parents: Sequence[str], cards: dict):
    """K3: mixed-radix code: child + card(child)·(last parent + card(last)·(…first parent)); null if a code is null or
    outside its card (an unseen value), so it never takes another combination's code."""
    return pack_codes([(F.col(c), int(cards[c])) for c in [*parents, child]])


@dataclass
class HighOrderEncoder:
    """K3–K5: per feature, the code of (feature value, parent values), compressed to the
    observed combinations (fitted once), plus the K4 constraint groups.

    The vocabularies of all features are one ranked table ``book`` (f, radix code, cfg: the parents' part of it, value: the feature's
    own, i: rank of the code within the feature), of at most min(N, Π cards) rows a feature; ``sizes`` has the rows of each. Nothing of it
    passes through the driver.
    """

    features: list[str]
    label: str
    k: int
    cards: dict
    parents: dict = field(default_factory=dict)
    book: DataFrame | None = None
    sizes: dict = field(default_factory=dict)
    edges: list = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], label: str, cards: dict, k: int = 2,
            edges: Sequence[Edge] | None = None) -> "HighOrderEncoder":
        edges = list(edges) if edges is not None else kdb_structure(df, features, label, k)
        parents = parents_without_label(edges, label, features)
        return cls(list(features), label, k, dict(cards), parents, edges=edges).fit_vocabulary(df)

    def _kind(self) -> str:
        wide = any(math.prod(int(self.cards[c]) for c in [*self.parents[f], f]) >= 2**63 for f in self.features)
        return "decimal(38,0)" if wide else "long"

    def _entry(self, f: str):
        """(code, cfg, value) of a row for a feature."""
        code = radix_code_expr(f, self.parents[f], self.cards).cast(self._kind())
        cfg = pack_codes([(F.col(p), int(self.cards[p])) for p in self.parents[f]]).cast(self._kind())
        return code.alias("code"), cfg.alias("cfg"), F.col(f).cast("int").alias("value")

    def fit_vocabulary(self, df: DataFrame) -> "HighOrderEncoder":
        """Observed codes of all features: one distributed distinct and one distributed rank."""
        from bayesloom.operators.encode import ranked

        entries = [F.struct(F.lit(i).alias("f"), *self._entry(f)) for i, f in enumerate(self.features)]
        seen = df.select(F.inline(F.array(*entries))).filter("code is not null").distinct()
        self.book, sizes = ranked(seen, "f", ["code"], "i")
        self.sizes = {f: sizes.get(i, 0) for i, f in enumerate(self.features)}
        return self

    def transform(self, df: DataFrame, suffix: str = "_ho") -> DataFrame:
        """Ordinal high-order code per feature (unseen combination → −1): a join with the feature's page of the book, which is
        broadcast only if it's small enough by its size."""
        from bayesloom.operators.sample import fits_broadcast

        for n, f in enumerate(self.features):
            page = self.book.filter(F.col("f") == n).select(F.col("code").alias("__v"), F.col("i").cast("int").alias("__i"))
            page = F.broadcast(page) if fits_broadcast(self.sizes[f], 0) else page
            code = self._entry(f)[0]
            df = (df.withColumn("__c", code).join(page, F.col("__c") == F.col("__v"), "left")
                  .withColumn(f + suffix, F.coalesce("__i", F.lit(-1)).cast("int")).drop("__c", "__v", "__i"))
        return df

    @property
    def vocab(self) -> dict[str, list[int]]:
        """The codes in order, on the driver: for vocabularies known to be small."""
        return {f: [int(r["code"]) for r in self.book.filter(F.col("f") == n).orderBy("i").select("code").collect()]
                for n, f in enumerate(self.features)}

    def constraints(self) -> DataFrame:
        """K4: (f, cfg, n): for each feature and observed parent configuration the number of child values seen under it
        (the sizes of the softmax groups)."""
        return self.book.groupBy("f", "cfg").agg(F.count(F.lit(1)).alias("n"))


def high_order_constraints(df: DataFrame, child: str, parents: Sequence[str]) -> DataFrame:
    """K4 as a table: (parent values…, n_child_values) for observed configurations."""
    if not parents:
        return df.agg(F.countDistinct(child).alias("n_child_values"))
    return df.groupBy(*parents).agg(F.countDistinct(child).alias("n_child_values"))


# ---------------------------------------------------------------- graph moves


def has_path(edges: Sequence[Edge], a: str, b: str) -> bool:
    adj: dict = {}
    for s, t in edges:
        adj.setdefault(s, []).append(t)
    stack, seen = [a], {a}
    while stack:
        n = stack.pop()
        if n == b:
            return True
        for m in adj.get(n, []):
            if m not in seen:
                seen.add(m)
                stack.append(m)
    return False


def neighbours(edges: Sequence[Edge], nodes: Sequence[str], tabu: Sequence[Op] = (), black_list=(),
               white_list=None, fixed_edges=(), max_indegree: int | None = None, allow_remove: bool = False,
               allow_flip: bool = True) -> list[Op]:
    """Legal one-edge moves: add (no cycle), flip (no other directed path), optionally remove."""
    es = set(edges)
    black, fixed = set(black_list), set(fixed_edges)
    white = set(white_list) if white_list is not None else None
    indeg: dict = {}
    for s, t in edges:
        indeg[t] = indeg.get(t, 0) + 1
    limit = max_indegree if max_indegree is not None else 10 ** 9
    ops = []
    for x in nodes:
        for y in nodes:
            if x == y or (x, y) in es or (y, x) in es:
                continue
            op = ("+", (x, y))
            if op in tabu or (x, y) in black or (white is not None and (x, y) not in white):
                continue
            if indeg.get(y, 0) + 1 > limit or has_path(edges, y, x):
                continue
            ops.append(op)
    if allow_remove:
        for x, y in edges:
            op = ("-", (x, y))
            if op not in tabu and (x, y) not in fixed:
                ops.append(op)
    if allow_flip:
        for x, y in edges:
            op = ("flip", (x, y))
            if op in tabu or ("flip", (y, x)) in tabu or (x, y) in fixed or (y, x) in black:
                continue
            if white is not None and (y, x) not in white:
                continue
            if indeg.get(x, 0) + 1 > limit:
                continue
            rest = [e for e in edges if e != (x, y)]
            if has_path(rest, x, y):
                continue
            ops.append(op)
    return ops


def apply_op(edges: Sequence[Edge], op: Op | None) -> list[Edge]:
    """Add / remove / flip / no-op."""
    if op is None:
        return list(edges)
    kind, (x, y) = op
    if kind == "+":
        return list(edges) + [(x, y)]
    if kind == "-":
        return [e for e in edges if e != (x, y)]
    if kind == "flip":
        return [e for e in edges if e != (x, y)] + [(y, x)]
    raise ValueError(f"unknown op {kind}")


def changed_families(edges: Sequence[Edge], op: Op) -> list[str]:
    kind, (x, y) = op
    return [y] if kind in ("+", "-") else [x, y]


def move_families(edges: Sequence[Edge], nodes: Sequence[str], op: Op) -> list[tuple]:
    """Families that a move changes, before and after it."""
    old, new = parent_sets(edges, nodes), parent_sets(apply_op(edges, op), nodes)
    return [(c, ps[c]) for c in changed_families(edges, op) for ps in (old, new)]


class FamilyScoreCache:
    """Driver-side cache of local scores keyed by (child, parents); misses of one step are
    scored together in a single Spark job (K11)."""

    def __init__(self, df: DataFrame, nodes: Sequence[str], cards: dict, kind: str | Callable = "bic",
                 n_rows: float | None = None, weight: str | None = None, **kw):
        from bayesloom.operators.scores import compacted, moments
        self.nodes = list(nodes)
        self.cards = cards
        self.kind = kind
        self.kw = kw
        self.base = compacted(df, self.nodes, weight)
        self.n_rows = n_rows or float(self.base.agg(F.sum("w")).first()[0])
        self.cache: dict = {}
        self.jobs = 0
        # the Gaussian score needs the d × d moments only: one job for the whole search
        self.moments = moments(self.base, self.nodes, "w") if kind == "bic-g" else None

    def key(self, child: str, parents) -> tuple:
        pos = {n: i for i, n in enumerate(self.nodes)}
        return child, tuple(sorted(parents, key=lambda p: pos[p]))

    def scores(self, fams: Sequence[tuple]) -> dict:
        keys = [self.key(c, p) for c, p in fams]
        miss = sorted({k for k in keys if k not in self.cache})
        if miss and self.moments:
            for child, parents in miss:
                self.cache[child, parents] = gaussian_family_score(self.moments, child, parents)
        elif miss:
            rows = local_scores(self.base, miss, self.cards, self.kind, compacted=True, n_rows=self.n_rows,
                                **self.kw).collect()
            self.jobs += 1
            for r in rows:
                self.cache[miss[r["fam"]]] = float(r["score"])
        return {k: self.cache[k] for k in keys}


def score_neighbours(cache: FamilyScoreCache, edges: Sequence[Edge], ops: Sequence[Op]) -> list[tuple[Op, float]]:
    """Δ = Σ new local scores − Σ old local scores of the changed families."""
    ps = parent_sets(edges, cache.nodes)
    need = []
    plans = []
    for op in ops:
        new_ps = parent_sets(apply_op(edges, op), cache.nodes)
        fams = changed_families(edges, op)
        olds = [(c, ps[c]) for c in fams]
        news = [(c, new_ps[c]) for c in fams]
        need += olds + news
        plans.append((op, olds, news))
    sc = cache.scores(need)
    out = []
    for op, olds, news in plans:
        delta = sum(sc[cache.key(*f)] for f in news) - sum(sc[cache.key(*f)] for f in olds)
        out.append((op, delta + structure_prior_ratio(op[0], cache.kind) + 0.0))
    return out


def op_sort_key(op: Op) -> str:
    kind, (x, y) = op
    return f"{kind}|{x}|{y}"


def hill_climb_step(cache: FamilyScoreCache, edges: Sequence[Edge], tabu: list | None = None,
                    epsilon: float = 1e-4, tabu_length: int = 1000, **constraints) -> tuple[Op | None, float]:
    """Best legal move by Δ (ties by op text); None when the best Δ < ε.

    The reverse of an applied add (or the flip itself) goes on the tabu list, which holds the last ``tabu_length``.
    """
    tabu = tabu if tabu is not None else []
    ops = neighbours(edges, cache.nodes, tabu=tabu, **constraints)
    if not ops:
        return None, 0.0
    scored = score_neighbours(cache, edges, ops)
    best_op, best = max(scored, key=lambda t: (round(t[1], 9), _neg(op_sort_key(t[0]))))
    if best < epsilon:
        return None, best
    kind, (x, y) = best_op
    tabu.append(("-", (x, y)) if kind == "+" else best_op)
    del tabu[:-tabu_length]
    return best_op, best


def _neg(s: str):
    return tuple(-ord(ch) for ch in s)


def hill_climb(df: DataFrame, nodes: Sequence[str], cards: dict, kind="bic", start: Sequence[Edge] = (),
               max_iter: int = 1_000_000, epsilon: float = 1e-4, cache: FamilyScoreCache | None = None,
               **constraints) -> list[Edge]:
    """Repeat K12 to a local optimum (one Spark job per step)."""
    cache = cache or FamilyScoreCache(df, nodes, cards, kind)
    edges, tabu = list(start), []
    for _ in range(max_iter):
        op, _d = hill_climb_step(cache, edges, tabu, epsilon, **constraints)
        if op is None:
            break
        edges = apply_op(edges, op)
    return edges


def pairwise_mi(df: DataFrame, nodes: Sequence[str], base: float = 2.0, weight=None, compacted=False) -> dict:
    """MI of every unordered pair, one family-count job."""
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:]]
    ct = family_counts(df, [(a, (b,)) for a, b in pairs], weight, compacted)
    rows = _mi_from_pairs(ct, base).collect()
    out = {}
    for r in rows:
        a, b = pairs[r["fam"]]
        out[(a, b)] = out[(b, a)] = float(r["mi"])
    return out


def tree_search(df: DataFrame, nodes: Sequence[str], root: str | None = None, digits: int = 10, **kw) -> list[Edge]:
    """Maximum spanning tree on pairwise MI (Chow–Liu), directed away from the root.

    Root defaults to the node with the largest MI sum. Prim on the driver over the
    d×d matrix; ties broken by node position.
    """
    mi = {k: round(v, digits) for k, v in pairwise_mi(df, nodes, **kw).items()}
    pos = {n: i for i, n in enumerate(nodes)}
    if root is None:
        root = max(nodes, key=lambda n: (round(sum(mi.get((n, m), 0.0) for m in nodes if m != n), digits), -pos[n]))
    inside, edges = {root}, []
    while len(inside) < len(nodes):
        best = None
        for a in sorted(inside, key=pos.get):
            for b in nodes:
                if b in inside:
                    continue
                cand = (mi.get((a, b), 0.0), -pos[a], -pos[b])
                if best is None or cand > best[0]:
                    best = (cand, a, b)
        _, a, b = best
        edges.append((a, b))
        inside.add(b)
    return edges


def mi_ordered_candidates(edges: Sequence[Edge], order: Sequence[str]) -> list[Edge]:
    """Candidate edges from a lower-MI node to a higher-MI node, minus existing edges."""
    rank = {n: i for i, n in enumerate(order)}
    es = set(edges)
    return [(s, t) for s in order for t in order if rank[s] > rank[t] and (s, t) not in es]


def state_key(edges: Sequence[Edge]) -> str:
    """Set-equality key of a DAG (sha-256 of the sorted 'src>dst' list)."""
    txt = ";".join(sorted(f"{s}>{t}" for s, t in edges))
    return hashlib.sha256(txt.encode("utf-8")).hexdigest()


def state_key_df(edges: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """K18 on an edge table: same key as :func:`state_key`, per group."""
    txt = F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws(">", "src", "dst"))))
    return edges.groupBy(*group_cols).agg(F.sha2(txt, 256).alias("state_key"))


def import_adjacency(matrix, columns: Sequence[str], label: str | None = None) -> list[Edge]:
    """d×d 0/1 matrix (row = parent, column = child) → edges, on top of label → feature."""
    edges = naive_structure(columns, label) if label else []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if matrix[i][j] == 1:
                edges.append((a, b))
    return edges


def topological_order(edges: Sequence[Edge], nodes: Sequence[str]) -> list[str]:
    """Kahn's order, ties by node position."""
    pos = {n: i for i, n in enumerate(nodes)}
    indeg = {n: 0 for n in nodes}
    adj: dict = {n: [] for n in nodes}
    for s, t in edges:
        indeg[t] += 1
        adj[s].append(t)
    ready = sorted([n for n in nodes if indeg[n] == 0], key=pos.get)
    out = []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for m in adj[n]:
            indeg[m] -= 1
            if indeg[m] == 0:
                ready.append(m)
        ready.sort(key=pos.get)
    if len(out) != len(nodes):
        raise ValueError("graph has a cycle")
    return out
