"""Category recommendations by matrix factorisation of category distances (C3).

Ratings are (user, item, rating) triples built from named distance triples:
user = id of the first name, item = id of the second (unknown name -> 0).
The factorisation is Spark ML's ALS (explicit ratings)."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.operators.inner_product import top_inner_products
from topicspace.operators.labels import lookup

RATING_TRANSFORMS = {
    "identity": lambda d: d,                 # as the original job: the farthest ranks first
    "negate": lambda d: -d,
    "inverse": lambda d: 1.0 / (1.0 + d),    # nearer categories rate higher
}


def ratings_from_distances(distances: DataFrame, dictionary: DataFrame, name: str = "name",
                           id: str = "category_id", rating_transform: str = "identity",
                           default: int = 0) -> DataFrame:
    """Named triples ``(name1, name2, distance)`` -> ``(user, item, rating)``."""
    d = dictionary.select(F.col(name), F.col(id))
    u = lookup(distances, d.withColumnRenamed(name, "name1").withColumnRenamed(id, "user"),
               "name1", "user", default)
    i = lookup(u, d.withColumnRenamed(name, "name2").withColumnRenamed(id, "item"),
               "name2", "item", default)
    fn = RATING_TRANSFORMS[rating_transform]
    return i.select(F.col("user").cast("int"), F.col("item").cast("int"),
                    fn(F.col("distance")).cast("double").alias("rating"))


def fit_recommender(ratings: DataFrame, rank: int = 8, max_iter: int = 6, reg: float = 0.01,
                    seed: int = 0, symmetric: bool = False) -> ALSModel:
    """ALS on explicit ratings (rank 8, 6 iterations and regularisation 0.01 by
    default). With ``symmetric`` every pair is also given in the other direction."""
    if symmetric:
        ratings = ratings.unionByName(ratings.select(
            F.col("item").alias("user"), F.col("user").alias("item"), "rating"))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, seed=seed, userCol="user",
              itemCol="item", ratingCol="rating", coldStartStrategy="drop")
    return als.fit(ratings)


def recommend(model: ALSModel, k: int = 5, side: str = "users_for_items",
              keep: DataFrame | None = None, exclude_self: bool = False,
              names: DataFrame | None = None, name: str = "name",
              id: str = "category_id") -> DataFrame:
    """Top-``k`` recommendations ``(item, user, rating, rank)``.

    ``side='users_for_items'``: the k best users of every item (what the
    original code computes); ``'items_for_users'``: the k best items of every
    user (what its published file holds). ``keep`` (ids in column ``id``) keeps
    only groups whose key is listed, and only those are scored, each against the items that
    the bound of their norms leaves (``top_inner_products``); ``exclude_self`` drops the pair of a
    category with itself (asking for one more so k rows remain); ``names``
    replaces ids by names (unknown -> '')."""
    extra = 1 if exclude_self else 0
    if side not in ("users_for_items", "items_for_users"):
        raise ValueError("side must be 'users_for_items' or 'items_for_users'")
    key, other = ("item", "user") if side == "users_for_items" else ("user", "item")
    factors = {"item": model.itemFactors, "user": model.userFactors}
    asked = factors[key].select(F.col("id").alias(key), F.col("features").alias("vec"))
    if keep is not None:
        asked = asked.join(keep.select(F.col(id).cast("int").alias(key)).distinct(), key, "left_semi")
    found = top_inner_products(asked, factors[other].select(F.col("id").alias(other),
                                                            F.col("features").alias("vec")),
                               k + extra, query=key, item=other, out="rating", rank="_p")
    rows = found.select(key, other, F.col("rating").cast("float").cast("double").alias("rating"), "_p")
    if exclude_self:
        rows = rows.where(F.col(key) != F.col(other))
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(F.col("_p"))
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_p")
    if names is not None:
        nm = names.select(F.col(id), F.col(name))
        rows = (lookup(rows, nm.withColumnRenamed(id, "item").withColumnRenamed(name, "_in"),
                       "item", "_in", "")
                .transform(lambda d: lookup(d, nm.withColumnRenamed(id, "user")
                                            .withColumnRenamed(name, "_un"), "user", "_un", ""))
                .select(F.col("_in").alias("item"), F.col("_un").alias("user"), "rating", "rank"))
    return rows.select("item", "user", "rating", "rank")


def recommendation_lines(recs: DataFrame) -> DataFrame:
    """``item,user,rating`` text rows, the layout of the original output file."""
    return recs.select(F.concat_ws(",", "item", "user", F.col("rating").cast("string")).alias("line"))
