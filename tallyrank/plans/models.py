"""Recommenders for the experiment runner: each fits tables on train rows and scores (user, item) rows with them.

A fitted model is tables alone, so that it can be written, read back and scored on any cluster. Neural parts that need
libraries or weights that are not here have stand-ins, named in the classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot
from ..operators import alternating, factors, graph, interactions, neighbours, pairwise
from ..operators.lineage import cut
from ..sources.readers import plain_name

Tables = dict[str, DataFrame]


class Model:
    """Parameters, `fit` and `score`. `score` gives every row of the pairs a number, also for unknown users and items."""

    #: Tables that a fitted model has.
    tables: tuple[str, ...] = ()

    def __init__(self, **params: object):
        self.params = params

    def fit(self, train: DataFrame) -> Tables:
        raise NotImplementedError

    def score(self, pairs: DataFrame, tables: Tables, train: DataFrame) -> DataFrame:
        raise NotImplementedError

    def take(self, name: str, default):
        return self.params.get(name, default)

    def positive(self, train: DataFrame) -> DataFrame:
        """Rows above the model's threshold; if there are none, those above 0."""
        return interactions.positives(train, float(self.take("positive_threshold", 0.0)), fallback=True)


MODELS: dict[str, type[Model]] = {}


def register_model(*names: str) -> Callable[[type[Model]], type[Model]]:
    def add(kind: type[Model]) -> type[Model]:
        for name in names:
            MODELS[plain_name(name)] = kind
        return kind

    return add


@register_model("popularity")
class Popularity(Model):
    tables = ("items",)

    def fit(self, train):
        return {"items": interactions.popularity(train)}

    def score(self, pairs, tables, train):
        known = tables["items"].select("item", F.col("popularity").alias("score"))
        return pairs.join(known, "item", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


@register_model("itemknn", "ItemKNNModel")
class ItemNeighbours(Model):
    """`exclude_seen` gives what a user has in the train rows minus infinity; evaluation rows may repeat such items, so it
    is off unless asked for."""

    tables = ("neighbours", "items", "means")

    def _own(self, train):
        return neighbours.merged(train, self.take("positive_threshold", None))

    def fit(self, train):
        own = self._own(train)
        least = float(self.take("min_similarity", 0.0))
        found = neighbours.nearest(own, self.take("similarity", "cosine"), float(self.take("shrinkage", 0.0)), int(self.take("k", self.take("k_neighbors", 200))), least if least > 0 else None)
        return {"neighbours": found, "items": interactions.popularity(train), "means": own.groupBy("item").agg(F.avg("label").alias("mean"))}

    def score(self, pairs, tables, train):
        own = self._own(train)
        mode = self.take("mode", "weighted")
        scored = neighbours.scores(own, tables["neighbours"], mode, bool(self.take("normalise", False)), tables["means"] if mode == "centred" else None)
        mean = factors.global_mean(own) if self.take("cold", "popularity") == "global_mean" else 0.0
        return neighbours.rules(pairs, scored, own, tables["items"], bool(self.take("exclude_seen", False)), self.take("cold", "popularity"), mean)


@register_model("als", "ALSModel")
class Als(Model):
    """Factors and biases by alternating solutions. With `early_stopping` a twentieth of the rows, by hash, is kept apart, and the sweep
    with the least error on it is kept; otherwise the one with the least error on the train rows."""

    tables = ("users", "items", "mean", "popular")

    def fit(self, train):
        rows, apart = neighbours.merged(train), None
        if self.take("early_stopping", False):
            held = F.pmod(F.xxhash64("user", "item"), F.lit(20)) == 0
            rows = cut(rows)
            rows, apart = rows.where(~held), rows.where(held)
        found = alternating.fit(
            rows, int(self.take("n_factors", self.take("factors", 64))), int(self.take("n_iterations", self.take("iterations", 20))), float(self.take("lambda_", self.take("regularization", 0.1))),
            bool(self.take("use_biases", True)), bool(self.take("weighted_regularization", False)), float(self.take("subsample_fraction", 1.0)), float(self.take("prune_threshold", 0.0) or 0.0),
            apart, int(self.take("early_stopping_patience", 3)), int(self.take("seed", 42)),
        )
        popular = interactions.popularity(train).orderBy(F.desc("n"), "item").limit(int(self.take("popular", 100))).select("item")
        return {"users": found.users, "items": found.items, "mean": train.sparkSession.createDataFrame([(found.mean,)], "mean double"), "popular": popular}

    def score(self, pairs, tables, train):
        mean = tables["mean"].first()["mean"]
        scored = factors.score(pairs, tables["users"], tables["items"], mean)
        return factors.cold_start(scored, tables["users"], tables["items"], tables["popular"], mean)


@register_model("nmf", "NMFRecommender")
class Nmf(Model):
    """Non-negative factors by multiplicative updates; the best of `runs` starts by error over all cells."""

    tables = ("users", "items", "popular")

    def fit(self, train):
        rows = factors.scaled_labels(neighbours.merged(train), float(self.take("positive_threshold", 0.0)))
        found = alternating.fit_nonnegative(
            rows, int(self.take("n_components", self.take("factors", 64))), int(self.take("max_iter", self.take("iterations", 20))), float(self.take("tol", 1e-4)), 0.0,
            float(self.take("alpha_W", 0.0)), int(self.take("random_state", self.take("seed", 42))), int(self.take("n_runs", self.take("runs", 1))),
        )
        popular = interactions.popularity(train).orderBy(F.desc("n"), "item").limit(int(self.take("popular", 100))).select("item")
        return {"users": alternating.with_bias(found.users.select("user", "factors")), "items": alternating.with_bias(found.items.select("item", "factors")), "popular": popular}

    def score(self, pairs, tables, train):
        return factors.cold_start(factors.score(pairs, tables["users"], tables["items"], 0.0), tables["users"], tables["items"], tables["popular"], 0.0)


def _cold(params: Model, default: float = -1e9) -> float:
    return {"neg_inf": -1e9, "zero": 0.0, "mean": 0.0}.get(str(params.take("cold_start_score", "neg_inf")), default)


@register_model("lightfm", "LightFMModel")
class PairwiseFactors(Model):
    """Factors and item biases by pairwise ranking of seen over drawn items, by violations unless `loss` is bpr. A user or an
    item without train rows gets minus infinity, or `cold_start_score`."""

    tables = ("users", "items", "losses")

    def fit(self, train):
        found = pairwise.train(
            self.positive(train), int(self.take("embedding_dim", self.take("no_components", 64))), 0, int(self.take("epochs", 10)), int(self.take("batches", 1)), float(self.take("learning_rate", 0.05)),
            float(self.take("item_alpha", self.take("reg", 0.0))), str(self.take("loss", "warp")), "adagrad", None, True, int(self.take("seed", 42)), int(self.take("max_sampled", pairwise.MOST_DRAWS)),
        )
        return {"users": found.users, "items": found.items, "losses": _losses(train, found)}

    def score(self, pairs, tables, train):
        met = pairs.join(tables["users"].select("user", F.col("factors").alias("__u")), "user", "left").join(tables["items"].select("item", F.col("factors").alias("__v"), F.col("bias").alias("__b")), "item", "left")
        cold = _cold(self) if "cold_start_score" in self.params else float("-inf")
        return met.select(*pairs.columns, F.coalesce(dot("__u", "__v") + F.col("__b"), F.lit(cold)).alias("score"))


def _losses(train: DataFrame, found: pairwise.Trained) -> DataFrame:
    return train.sparkSession.createDataFrame(list(enumerate(found.losses, 1)), "epoch int, loss double")


@register_model("lightgcn", "LightGCNModel")
class GraphFactors(Model):
    """Embeddings trained by pairwise ranking through the layers of the graph of users and items; the (weighted) mean of all layers
    scores. An unknown user or item gets `cold_start_score`: neg_inf, zero, or popularity for a known item."""

    tables = ("users", "items", "popular", "losses")

    def fit(self, train):
        p = self.positive(train)
        found = pairwise.train(
            p, int(self.take("embedding_dim", 64)), int(self.take("n_layers", 3)), int(self.take("epochs", 100)), int(self.take("batches", 1)), float(self.take("learning_rate", 1e-3)),
            float(self.take("reg_weight", 1e-4)), "bpr", "adam", self.take("layer_weights", None), False, int(self.take("seed", 42)),
        )
        return {"users": found.users, "items": found.items, "popular": interactions.popularity(p.select("user", "item").distinct()), "losses": _losses(train, found)}

    def score(self, pairs, tables, train):
        met = pairs.join(tables["users"].select("user", F.col("factors").alias("__u")), "user", "left").join(tables["items"].select("item", F.col("factors").alias("__v")), "item", "left")
        out = dot("__u", "__v")
        if self.take("cold_start_score", "neg_inf") == "popularity":
            met = met.join(tables["popular"].select("item", F.col("popularity").alias("__p")), "item", "left")
            return met.select(*pairs.columns, F.coalesce(out, F.col("__p"), F.lit(0.0)).alias("score"))
        return met.select(*pairs.columns, F.coalesce(out, F.lit(_cold(self))).alias("score"))


@register_model("deepfm", "DeepFMModel", "fm")
class Machine(Model):
    """A factorisation machine over what the train rows say of the user and the item: means, numbers of rows, popularity.
    The deep part is left out."""

    tables = ("users", "items", "weights")
    FEATURES = ("u_mean", "u_n", "i_mean", "i_n")

    def fit(self, train):
        side = lambda key, at: train.groupBy(key).agg(F.avg("label").alias(f"{at}_mean"), F.log1p(F.count("*")).alias(f"{at}_n"))
        users, items = side("user", "u"), side("item", "i")
        fitted = factors.train_fm(train.join(users, "user").join(items, "item"), list(self.FEATURES), int(self.take("factors", 4)), int(self.take("iterations", 20)), int(self.take("seed", 42))).stages[-1]
        weights = [(float(fitted.intercept), fitted.linear.toArray().tolist(), fitted.factors.toArray().tolist())]
        return {"users": users, "items": items, "weights": train.sparkSession.createDataFrame(weights, "bias double, linear array<double>, factors array<array<double>>")}

    def score(self, pairs, tables, train):
        w = tables["weights"].first()
        met = pairs.join(tables["users"], "user", "left").join(tables["items"], "item", "left")
        rows = met.withColumn("features", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in self.FEATURES]))
        return factors.fm_score(rows, list(w["linear"]), [list(x) for x in w["factors"]], w["bias"]).select(*pairs.columns, "score")


@register_model("bert4rec", "Bert4REC", "sequence")
class Sequence(Model):
    """Items by how often they follow a user's last ones in all sequences; stands in for a transformer over sequences. A
    user or item without a sequence gets `oov_score`."""

    tables = ("steps", "lasts")

    def fit(self, train):
        back = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("time"), F.desc("item"), F.desc("label")))
        lasts = train.withColumn("back", back).where(F.col("back") <= int(self.take("window", 3))).select("user", "item", "back")
        return {"steps": graph.transitions(train), "lasts": lasts}

    def score(self, pairs, tables, train):
        near = tables["lasts"].join(tables["steps"], "item").groupBy("user", F.col("next").alias("item")).agg(F.sum(F.col("share") / F.col("back")).alias("score"))
        known = tables["steps"].select(F.col("next").alias("item")).distinct().withColumn("__known", F.lit(True))
        users = tables["lasts"].select("user").distinct().withColumn("__user", F.lit(True))
        met = pairs.join(near, ["user", "item"], "left").join(known, "item", "left").join(users, "user", "left")
        out: Column = F.when(F.col("__known").isNull() | F.col("__user").isNull(), F.lit(float(self.take("oov_score", -1e9)))).otherwise(F.coalesce("score", F.lit(0.0)))
        return met.select(*pairs.columns, out.alias("score"))
