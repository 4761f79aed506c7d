"""Reinforcement-style structure search.

The transition log, Q table and policy are DataFrames:
  log    (episode, epoch, step, state_key, action, reward, next_state_key, ls)
  q      (state_key, action, q)
  policy (state_key, action, value)
The operators K20–K26 work on such tables of any size. The search (K27) itself keeps its few rows, one per step, in Python and
returns them as tables; every data-dependent number in it (family scores, samples, discriminator) is a Spark job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayesloom.operators import structure as K
from bayesloom.operators.scores import complexity_penalty, parent_sets

LOG_SCHEMA = ("episode int, epoch int, step int, state_key string, action string, reward double, "
              "next_state_key string, ls double")
Q_SCHEMA = "state_key string, action string, q double"


def step_reward(scores: DataFrame, penalty: float, order: Sequence[str] = ("epoch", "step")) -> DataFrame:
    """reward = (score − previous score in the episode) − penalty.

    ``scores`` has (episode, epoch, step, score) and one row per step, the first row of
    an episode holding the initial score (its reward is null).
    """
    w = Window.partitionBy("episode").orderBy(*order)
    return scores.withColumn("reward", F.col("score") - F.lag("score").over(w) - F.lit(float(penalty)))


def n_step_return(log: DataFrame, gamma: float = 0.9) -> DataFrame:
    """G = Σ reward·(1 − ls)·γ^i over each (episode, epoch) buffer, i = position by step."""
    w = Window.partitionBy("episode", "epoch").orderBy("step")
    t = log.withColumn("__i", F.row_number().over(w) - 1)
    term = F.col("reward") * (F.lit(1.0) - F.col("ls")) * F.pow(F.lit(float(gamma)), F.col("__i"))
    return t.groupBy("episode", "epoch").agg(F.sum(term).alias("g"))


def last_transition(log: DataFrame) -> DataFrame:
    """The (S, A) of the last step of each buffer (where the reference applies the return)."""
    last = F.max_by(F.struct("state_key", "action"), "step").alias("t")
    return log.groupBy("episode", "epoch").agg(last).select("episode", "epoch", "t.state_key", "t.action")


def q_update(q: DataFrame, log: DataFrame, gamma: float = 0.9, alpha: float = 0.1) -> DataFrame:
    """Q ← Q + α(G − Q) for the last (S, A) of each buffer; a missing Q is 0."""
    g = n_step_return(log, gamma).join(last_transition(log), ["episode", "epoch"])
    upd = g.groupBy("state_key", "action").agg(F.avg("g").alias("g"))
    j = q.join(upd, ["state_key", "action"], "full_outer")
    old = F.coalesce(F.col("q"), F.lit(0.0))
    newq = F.when(F.col("g").isNull(), old).otherwise(old + F.lit(float(alpha)) * (F.col("g") - old))
    return j.select("state_key", "action", newq.alias("q"))


def policy_blend(policy: DataFrame | None, q: DataFrame, log: DataFrame, beta: float) -> DataFrame:
    """value = β·reward·(1 − ls) + (1 − β)·Q for logged pairs already in Q.

    The buffer is read last-in-first-out, so for a pair logged twice the earliest step
    is the final write.
    """
    write = F.min_by(F.struct("reward", "ls"), F.struct("episode", "epoch", "step")).alias("t")
    first = log.groupBy("state_key", "action").agg(write).select("state_key", "action", "t.reward", "t.ls")
    val = F.lit(float(beta)) * F.col("reward") * (F.lit(1.0) - F.col("ls")) + F.lit(1.0 - float(beta)) * F.col("q")
    new = first.join(q, ["state_key", "action"], "inner").select("state_key", "action", val.alias("value"))
    if policy is None:
        return new
    return policy.join(new, ["state_key", "action"], "left_anti").unionByName(new)


def beta_decay(beta: float, decay: float = 0.99, beta_min: float = 0.1) -> float:
    """β ← β·decay while β > β_min (once per episode)."""
    return beta * decay if beta > beta_min else beta


def q_merge(tables: Sequence[DataFrame], value: str = "q") -> DataFrame:
    """Average per (state, action) over all snapshots."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    return u.groupBy("state_key", "action").agg(F.avg(value).alias(value))


def select_best_structure(candidates: DataFrame, mode: str = "max") -> DataFrame:
    """State key, edges and score of the candidate with the best score (ties, to nine digits: the smallest state key);
    ``mode='min'`` takes the lowest score. No candidate gives no row."""
    score = F.round("score", 9)  # networks of one equivalence class differ in the last digits of a sum
    order = score if mode == "min" else -score
    out = ["state_key", *(["edges"] if "edges" in candidates.columns else []), "score"]
    best = candidates.agg(F.min(F.struct(order.alias("o"), *out)).alias("b"))
    return best.filter("b is not null").select(*[f"b.{c}" for c in out])


def best_known_action(q: DataFrame, state: str | None = None) -> DataFrame:
    """Argmax-Q action per state (ties by action text); rows with Q < 0 are not offered."""
    t = q if state is None else q.filter(F.col("state_key") == state)
    best = F.min(F.struct((-F.col("q")).alias("o"), "action", "q")).alias("b")
    return t.groupBy("state_key").agg(best).filter("b.q >= 0").select("state_key", "b.action", "b.q")


def action_text(op) -> str:
    if op is None:
        return "none"
    kind, (x, y) = op
    return f"{kind}|{x}|{y}"


def parse_action(txt: str):
    if txt in (None, "none"):
        return None
    kind, x, y = txt.split("|")
    return kind, (x, y)


# ---------------------------------------------------------------- K27 hybrid search


@dataclass
class SearchResult:
    """``log``, ``candidates`` (every structure reached) and ``snapshots`` (every episode's Q and policy after each epoch) as tables;
    ``q`` and ``policy`` are the snapshots' averages (K24), ``best`` the best candidate (K25)."""

    edges: list
    best_edges: list
    best_score: float
    log: DataFrame
    q: DataFrame
    policy: DataFrame | None
    candidates: DataFrame
    snapshots: DataFrame
    jobs: int = 0


@dataclass
class _Episode:
    number: int
    edges: list
    score: float
    q: dict
    policy: dict
    tabu: list = field(default_factory=list)
    step: int = 0
    buffer: list = field(default_factory=list)


@dataclass
class HybridSearch:
    """Per epoch ``n`` greedy hill-climb steps, one policy step (the legal action of the highest value in the blended
    policy if that is not negative, else a legal move drawn by hash uniform; with probability ε an MI-ordered candidate), with
    ``gan`` the discriminator score ``ls`` of the network's own sample, then K21–K23. Episodes start from the naive structure.

    Episodes run in lock-step, ``parallel`` at a time (all by default): a step scores the candidate families of all of them in one
    job, and an epoch fits, samples and discriminates all their networks together, so the number of jobs follows the steps and
    not the episodes. Each has its own log, Q and policy; its moves are those it would make alone. The next batch of episodes starts from the
    snapshots' averages. The best structure is the best one reached after any step.
    """

    nodes: list
    label: str
    cards: dict
    episodes: int = 2
    epochs: int = 5
    n: int = 3
    epsilon: float = 0.1
    gamma: float = 0.9
    alpha: float = 0.1
    beta: float = 0.9
    score: str = "bic"
    gan: bool = False
    seed: int = 42
    max_indegree: int | None = None
    parallel: int | None = None
    first_episode: int = 0

    def run(self, df: DataFrame, start_edges=None, discriminator_fn=None, key: str = "row_key") -> SearchResult:
        """``discriminator_fn`` (networks, epoch) → ls of each network takes the place of the default one, which reads ``key``;
        ``networks`` is episode → edges."""
        spark = df.sparkSession
        feats = [c for c in self.nodes if c != self.label]
        cache = K.FamilyScoreCache(df, self.nodes, self.cards, self.score)
        mi, _ = K.mi_cmi(cache.base, feats, self.label, weight="w", compacted=True)
        order = K.mi_order(mi, feats)
        penalty = complexity_penalty(len(self.nodes), cache.n_rows)
        if self.gan and discriminator_fn is None:
            discriminator_fn = self._discriminator(df, cache, feats, key)
        start = K.naive_structure(feats, self.label) if start_edges is None else list(start_edges)
        start_score = self._score(cache, start)
        logs, reached, snapshots = [], [], []
        q, policy, beta, edges = {}, {}, self.beta, start
        numbers = list(range(self.first_episode, self.first_episode + self.episodes))
        size = self.parallel or max(1, len(numbers))
        for lo in range(0, len(numbers), size):
            batch = [_Episode(i, list(start), start_score, dict(q), dict(policy)) for i in numbers[lo:lo + size]]
            reached += [(e.number, -1, -1, K.state_key(e.edges), e.score, _edges_text(e.edges)) for e in batch]
            for epoch in range(self.epochs):
                for _ in range(self.n):
                    self._greedy_steps(cache, batch, epoch, penalty, reached)
                self._policy_steps(cache, batch, order, epoch, penalty, reached)
                ls = discriminator_fn({e.number: e.edges for e in batch}, epoch) if self.gan else {}
                for e in batch:
                    logs += self._learn(e, float(ls.get(e.number, 0.0)), beta)
                    snapshots += [(e.number, epoch, s, a, "q", v) for (s, a), v in e.q.items()]
                    snapshots += [(e.number, epoch, s, a, "policy", v) for (s, a), v in e.policy.items()]
            beta, edges = beta_decay(beta), batch[-1].edges
            if lo + size < len(numbers):
                q, policy = ({(r["state_key"], r["action"]): r["value"] for r in merge_snapshots(_snapshot_table(spark, snapshots), kind).collect()}
                             for kind in ("q", "policy"))
        table = _snapshot_table(spark, snapshots)
        candidates = spark.createDataFrame(reached, "episode int, epoch int, step int, state_key string, score double, edges string")
        best = select_best_structure(candidates).first()
        return SearchResult(edges, _parse_edges(best["edges"]) if best else [], best["score"] if best else -math.inf,
                            spark.createDataFrame(logs, LOG_SCHEMA), merge_snapshots(table, "q").withColumnRenamed("value", "q"),
                            merge_snapshots(table, "policy"), candidates, table, cache.jobs)

    def _score(self, cache, edges) -> float:
        ps = parent_sets(edges, self.nodes)
        return float(sum(cache.scores([(n, ps[n]) for n in self.nodes]).values()))

    def _move(self, cache, e: _Episode, op, epoch: int, penalty: float, reached: list) -> None:
        new = K.apply_op(e.edges, op)
        score = self._score(cache, new)
        e.buffer.append((e.number, epoch, e.step, K.state_key(e.edges), action_text(op), (score - e.score) - penalty, K.state_key(new)))
        reached.append((e.number, epoch, e.step, K.state_key(new), score, _edges_text(new)))
        e.edges, e.score, e.step = new, score, e.step + 1

    def _greedy_steps(self, cache, batch, epoch, penalty, reached) -> None:
        """One hill-climb step of every episode; what any of them needs is scored in one job."""
        need = [f for e in batch for op in K.neighbours(e.edges, self.nodes, tabu=e.tabu, max_indegree=self.max_indegree)
                for f in K.move_families(e.edges, self.nodes, op)]
        cache.scores(need)
        for e in batch:
            op, _delta = K.hill_climb_step(cache, e.edges, e.tabu, 1e-4, max_indegree=self.max_indegree)
            self._move(cache, e, op, epoch, penalty, reached)

    def _policy_steps(self, cache, batch, order, epoch, penalty, reached) -> None:
        ops = [self._policy_step(e.edges, order, e.policy, e.number, epoch) for e in batch]
        cache.scores([f for e, op in zip(batch, ops) if op is not None for f in K.move_families(e.edges, self.nodes, op)])
        for e, op in zip(batch, ops):
            self._move(cache, e, op, epoch, penalty, reached)

    def _learn(self, e: _Episode, ls: float, beta: float) -> list:
        """K21–K23 on an epoch's buffer (the formulas of the table operators); gives the buffer's log rows."""
        rows = [r + (ls,) for r in e.buffer]
        g = sum(r[5] * (1 - ls) * self.gamma ** i for i, r in enumerate(rows))
        last = rows[-1][3:5]
        e.q[last] = e.q.get(last, 0.0) + self.alpha * (g - e.q.get(last, 0.0))
        for r in reversed(rows):
            if r[3:5] in e.q:
                e.policy[r[3:5]] = beta * r[5] * (1 - ls) + (1 - beta) * e.q[r[3:5]]
        e.buffer = []
        return rows

    def _policy_step(self, edges, order, policy, ep, epoch):
        """The policy's best legal action in this state if its value isn't negative, else a legal move drawn by hash uniform;
        with probability ε an MI-ordered candidate, if there is one."""
        state = K.state_key(edges)
        legal = sorted(K.neighbours(edges, self.nodes, max_indegree=self.max_indegree), key=action_text)
        known = [(v, a) for (s, a), v in policy.items() if s == state and v >= 0 and parse_action(a) in set(legal)]
        draw = _hash01(f"{self.seed}|{ep}|{epoch}|pick")
        if _hash01(f"{self.seed}|{ep}|{epoch}|policy") < self.epsilon:
            cands = [("+", e) for e in K.mi_ordered_candidates(edges, order) if ("+", e) in set(legal)]
            if cands:
                return cands[int(draw * len(cands))]
        if known:
            return parse_action(max(known, key=lambda t: (t[0], _neg(t[1])))[1])
        return legal[int(draw * len(legal))] if legal else None

    def _discriminator(self, df, cache, feats, key):
        """Accuracy with which real rows are told from as many drawn from each network. The networks of all episodes are one network
        with as many times the nodes: one job for its tables, one sample, one aggregation per step of all discriminators."""
        from bayesloom.operators.cpt import fit_cpts_of
        from bayesloom.operators.evaluate import discriminators
        from bayesloom.operators.sample import ancestral_sample

        def ls(networks: dict, epoch: int) -> dict:
            cpts = fit_cpts_of(cache.base, networks, self.nodes, weight="w", compacted=True)
            name = "{1}@{0}".format
            nodes = [name(e, c) for e in networks for c in self.nodes]
            edges = [(name(e, s), name(e, t)) for e, net in networks.items() for s, t in net]
            cards = {name(e, c): self.cards[c] for e in networks for c in self.nodes}
            streams = {name(e, c): (f"{self.seed}|{e}|{epoch}", i) for e in networks for i, c in enumerate(self.nodes)}
            wide = ancestral_sample(df.sparkSession, cpts, edges, nodes, cards, int(cache.n_rows), streams=streams)
            rows = F.array(*[F.struct(F.lit(e).alias("__episode"), *[F.col(f"`{name(e, c)}`").alias(c) for c in feats]) for e in networks])
            drawn = wide.select("row_id", F.inline(rows))
            out = discriminators(df, drawn, feats, "__episode", seed=self.seed + epoch, key=key)
            cpts.unpersist()
            return {e: v["ls"] for e, v in out.items()}

        return ls


def merge_snapshots(snapshots: DataFrame, kind: str) -> DataFrame:
    """K24 on a table of snapshots: (state_key, action, value), the average of every key over all episodes' epochs."""
    return q_merge([snapshots.filter(F.col("kind") == kind).select("state_key", "action", "value")], "value")


def _snapshot_table(spark, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "episode int, epoch int, state_key string, action string, kind string, value double")


def _parse_edges(text: str) -> list:
    return [tuple(e.split(">")) for e in text.split(";")] if text else []


def _neg(s: str):
    return tuple(-ord(c) for c in s)


def _hash01(txt: str) -> float:
    import hashlib
    return (int(hashlib.md5(txt.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def _edges_text(edges) -> str:
    return ";".join(sorted(f"{s}>{t}" for s, t in edges))
