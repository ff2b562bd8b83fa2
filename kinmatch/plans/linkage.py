"""The whole chain from raw records to matches, step by step.

Each step's table is written once to the work folder and read back by later
steps and later runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.operators import blocking as B
from kinmatch.operators import decide as D
from kinmatch.operators import evaluate as E
from kinmatch.operators import features, models, normalize
from kinmatch.sources.tables import cached


@dataclass
class Linkage:
    """s1 and pool: raw records. truth: s1_id, cand_id of the records to learn from, which `scope` (entity_id) names."""

    spark: SparkSession
    work: str
    s1: DataFrame
    pool: DataFrame
    channels: tuple[B.Channel, ...] = B.CHANNELS
    rounds: int = 40

    def _step(self, name: str, build) -> DataFrame:
        return cached(self.spark, f"{self.work}/{name}", build)

    def normalized(self) -> tuple[DataFrame, DataFrame]:
        sides = {}

        def build(which: int):
            if not sides:
                sides[0], sides[1] = normalize.normalize_sources(self.s1, self.pool)
            return sides[which]

        return tuple(B.with_blocks(self._step(n, lambda k=k: build(k))) for k, n in enumerate(("s1", "pool")))

    def candidates(self) -> DataFrame:
        return self._step("candidates", lambda: B.candidates(*self.normalized(), self.channels))

    def features(self) -> DataFrame:
        return self._step("features", lambda: features.pair_features(self.candidates(), *self.normalized(), self.channels))

    def first_stage(self, truth: DataFrame) -> DataFrame:
        """Features, label and p, out of fold."""

        def build() -> DataFrame:
            df = self.features()
            names = [c for c in df.columns if c not in ("s1_id", "cand_id")]
            labelled = df.join(truth.withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").fillna(0, ["label"])
            return models.out_of_fold(labelled, names, learner=models.boosted_trees(self.rounds))

        return self._step("first_stage", build)

    def pair_model(self, truth: DataFrame) -> DataFrame:
        """p_llm of the uncertain band."""

        def build() -> DataFrame:
            both = features.paired(D.band(self.first_stage(truth)).select("s1_id", "cand_id", "label"), *self.normalized(), ("business_name", "business_address"))
            from kinmatch.functions.text import pair_text

            texts = both.withColumns({f"{x}_text": pair_text(F.col(f"{x}_business_name"), F.col(f"{x}_business_address")) for x in "ab"})
            return models.pair_model_scores(texts.select("s1_id", "cand_id", "label", "a_text", "b_text"))

        return self._step("pair_model", build)

    def second_stage(self, truth: DataFrame) -> DataFrame:
        """p1, p2 and the p chosen between them."""

        def build() -> DataFrame:
            first = self.first_stage(truth).select("s1_id", "cand_id", "p", "label")
            support = D.support_features(first, features.support_measures(D.supporters(first), self.normalized()[1]))
            scored = D.model_statistics(first.join(self.pair_model(truth).select("s1_id", "cand_id", "p_llm"), ["s1_id", "cand_id"], "left"), "p_llm")
            table = first.select("s1_id", "cand_id", "label").join(support, ["s1_id", "cand_id"]).join(D.group_statistics(first), ["s1_id", "cand_id"]).join(scored.select("s1_id", "cand_id", "p_llm", "llm_gap"), ["s1_id", "cand_id"])
            names = [c for c in table.columns if c not in ("s1_id", "cand_id", "label")]
            out = models.out_of_fold(table, names, learner=models.boosted_trees(self.rounds), name="p2")
            return D.fall_back(out.select("s1_id", "cand_id", "label", "p1", "p2"))

        return self._step("second_stage", build)

    def matches(self, truth: DataFrame) -> DataFrame:
        """The decision at the best thresholds for the truth."""
        pairs = self.second_stage(truth)
        best = D.tune(pairs, truth).first()
        return D.decide(pairs, best["t"], best["t_top"])

    def report(self, truth: DataFrame) -> DataFrame:
        scope = self.normalized()[0].select("entity_id", "country_key")
        return E.metric_pack(E.entity_scores(self.matches(truth), truth, scope))
