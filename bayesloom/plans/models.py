"""Model objects with the reference's public surface: ``fit`` → ``sample(n)`` → ``evaluate``.

All of them take a discrete (coded) table with a key column and a label; the mixed
model also takes raw numeric columns. Fitting and sampling are Spark jobs; the model
itself (edges, CPT rows, weights) is model-sized.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.operators import structure as K
from bayesloom.operators.cpt import fit_cpts, weights_to_cpts
from bayesloom.operators.evaluate import discriminator, tstr
from bayesloom.operators.predict import GaussianNB
from bayesloom.operators.scores import compacted
from bayesloom.operators.sample import ancestral_sample, gaussian_nb_sample
from bayesloom.operators.weights import DiscriminativeWeights
from bayesloom.session import cached


@dataclass
class BayesNetSynthesizer:
    """Structure (naive | kdb | tree | hill_climb | given edges) + ML CPTs + ancestral sampling."""

    structure: str = "kdb"
    k: int = 2
    score: str = "bic"
    edges: list = field(default_factory=list)
    nodes: list = field(default_factory=list)
    label: str = "target"
    cards: dict = field(default_factory=dict)
    cpts: DataFrame | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str, cards: dict, edges=None, weight: str | None = None) -> "BayesNetSynthesizer":
        """``weight``: column with the number of rows that a row stands for."""
        self.nodes, self.label, self.cards = list(features) + [label], label, dict(cards)
        base = compacted(df, self.nodes, weight)
        if edges is not None:
            self.edges = list(edges)
        elif self.structure == "naive":
            self.edges = K.naive_structure(features, label)
        elif self.structure == "kdb":
            self.edges = K.kdb_structure(base, list(features), label, self.k, weight="w", compacted=True)
        elif self.structure == "tree":
            self.edges = K.tree_search(base, self.nodes, weight="w", compacted=True)
        elif self.structure == "hill_climb":
            cache = K.FamilyScoreCache(df, self.nodes, self.cards, self.score, weight=weight)
            self.edges = K.hill_climb(df, self.nodes, self.cards, self.score, cache=cache)
            cache.base.unpersist()
        else:
            raise ValueError(self.structure)
        self.cpts = fit_cpts(base, self.edges, self.nodes, weight="w", compacted=True)
        return self

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        spark = self.cpts.sparkSession
        return ancestral_sample(spark, self.cpts, self.edges, self.nodes, self.cards, n, seed)

    def evaluate(self, test: DataFrame, n: int | None = None, classifiers=("lr",), seed: int = 42) -> dict:
        syn = self.sample(n or test.count(), seed).drop("row_id")
        return tstr(syn, test.select(*self.nodes), self.label, classifiers, seed)


@dataclass
class KDependenceGenerator:
    """kDB structure, high-order features, discriminative weights (G3), CPTs (G4), sampling.

    ``epochs`` gradient epochs follow the count-initialised warm-up; with ``gan=True`` each
    epoch also samples and trains the real-vs-synthetic discriminator (V7) and records
    its accuracy (the reference adds it as a constant to the loss, so it does not change
    the weights).
    """

    k: int = 2
    epochs: int = 5
    lr: float = 1.0
    gan: bool = False
    nodes: list = field(default_factory=list)
    label: str = "target"
    cards: dict = field(default_factory=dict)
    edges: list = field(default_factory=list)
    cpts: DataFrame | None = None
    weights: DiscriminativeWeights | None = None
    history: list = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, cards: dict, key: str = "row_key") -> "KDependenceGenerator":
        self.nodes, self.label, self.cards = list(features) + [label], label, dict(cards)
        base = compacted(df, self.nodes)
        enc = K.HighOrderEncoder.fit(base, list(features), label, cards, self.k,
                                     edges=K.kdb_structure(base, list(features), label, self.k, weight="w", compacted=True))
        self.edges = enc.edges
        ho = cached(enc.transform(base))
        classes = [r[0] for r in base.select(label).distinct().orderBy(label).collect()]  # at most the label's card
        self.weights = DiscriminativeWeights(enc, label, classes)
        self.weights.init_from_counts(ho)
        for ep in range(self.epochs):
            rec = {"epoch": ep, "cond_ll": self.weights.epoch(ho, self.lr)}
            if self.gan:
                self._set_cpts()
                syn = self.sample(int(self.weights.n_rows), seed=ep)
                rec.update(discriminator(df, syn, list(features), key=key))
            self.history.append(rec)
        self._set_cpts()
        ho.unpersist()
        base.unpersist()
        return self

    def _set_cpts(self) -> None:
        old, self.cpts = self.cpts, cached(weights_to_cpts(self.weights.log_weights(), self.cards))
        self.cpts.count()  # the weights of the next epoch take the place of these
        if old is not None:
            old.unpersist()

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        spark = self.cpts.sparkSession
        return ancestral_sample(spark, self.cpts, self.edges, self.nodes, self.cards, n, seed)

    def evaluate(self, test: DataFrame, n: int | None = None, classifiers=("lr",), seed: int = 42) -> dict:
        syn = self.sample(n or test.count(), seed).drop("row_id")
        return tstr(syn, test.select(*self.nodes), self.label, classifiers, seed)


@dataclass
class GaussianNBSynthesizer:
    """NB baseline: per-class Gaussians (G8) sampled with Φ⁻¹ of hash uniforms."""

    model: GaussianNB | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str, cards: dict | None = None) -> "GaussianNBSynthesizer":
        self.model = GaussianNB.fit(df, features, label)
        return self

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        from pyspark.sql import SparkSession
        return gaussian_nb_sample(SparkSession.getActiveSession(), self.model, n, seed)


@dataclass
class MixedSynthesizer:
    """M6: numeric columns → mixture codes (M1–M3), discrete model, sample, decode (M4)."""

    numeric: list
    k_modes: int = 10
    k: int = 2
    epochs: int = 0
    mixture: object = None
    generator: KDependenceGenerator | None = None
    label: str = "target"

    def fit(self, df: DataFrame, features: Sequence[str], label: str, cards: dict, key: str = "row_key") -> "MixedSynthesizer":
        from bayesloom.operators.discretise import BINS_PER_MODE, MixtureDiscretiser
        self.label = label
        self.mixture = MixtureDiscretiser.fit(df, self.numeric, k=self.k_modes)
        coded = self.mixture.transform(df)
        cards = dict(cards)
        for c in self.numeric:
            cards[c] = BINS_PER_MODE * len(self.mixture.weights[c])
        self.generator = KDependenceGenerator(k=self.k, epochs=self.epochs).fit(coded, list(features), label, cards, key)
        return self

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        s = self.generator.sample(n, seed)
        return self.mixture.inverse(s, "row_id", seed)
