"""Loaders of the public data sets' folders, by the names that settings call them by. Nothing is downloaded.

A loader gives interactions (or query-document pairs, for search) as `rows`, and where the files have them item texts
as `docs` (item, text) and weighted tags as `tags` (item, tag, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import joined_text
from ..operators import interactions
from ..sources import readers
from ..sources.readers import loader
from . import builders

Tables = dict[str, DataFrame]


def _text_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item").cast("string").alias("item"), "text")


def _genome(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return readers.csv(spark, f"{path}/genome-scores.csv", readers.TAG_SCORES), readers.csv(spark, f"{path}/genome-tags.csv", readers.TAG_NAMES)


@loader("movielens")
def movielens(spark: SparkSession, path: str, mode: str = "normal", fraction: float = 1.0, min_relevance: float = 0.8, seed: int = 42) -> Tables:
    """Ratings of users of middling activity; with mode query_as_user, tags as users of relevant movies."""
    movies = readers.csv(spark, f"{path}/movies.csv", readers.MOVIES)
    docs = _text_items(movies.select(F.col("movieId").alias("item"), builders.movie_document().alias("text")))
    if mode == "query_as_user":
        scores, names = _genome(spark, path)
        return {"rows": builders.tag_users(scores, min_relevance), "docs": docs}
    ratings = readers.csv(spark, f"{path}/ratings.csv", readers.RATINGS)
    return {"rows": builders.movie_ratings(ratings, movies, fraction, seed), "docs": docs}


@loader("movielens_search")
def movielens_search(spark: SparkSession, path: str, min_relevance: float = 0.8) -> Tables:
    scores, names = _genome(spark, path)
    return {"rows": builders.tag_pairs(scores, names, readers.csv(spark, f"{path}/movies.csv", readers.MOVIES), min_relevance)}


@loader("amazonElectronics")
def products(spark: SparkSession, path: str, mode: str = "normal", fraction: float = 1.0, core: int = 10, seed: int = 42) -> Tables:
    """Ratings of a k-core; with mode query_as_user, categories as users of their products."""
    items = readers.products(spark, f"{path}/meta_Electronics.json.gz")
    docs = _text_items(items.select("item", joined_text("title", "description", by=". ").alias("text")))
    if mode == "query_as_user":
        return {"rows": builders.category_users(items), "docs": docs}
    return {"rows": builders.product_ratings(readers.headerless(spark, f"{path}/ratings.csv"), fraction, core, seed), "docs": docs, "tags": builders.tags_of(items)}


@loader("amazonelectronics_search")
def products_search(spark: SparkSession, path: str, least: int = 10) -> Tables:
    return {"rows": builders.category_pairs(readers.products(spark, f"{path}/meta_Electronics.json.gz"), least)}


def _artists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tagged = readers.tsv(spark, f"{path}/user_taggedartists.dat").select(F.col("artistID").cast("bigint"), F.col("tagID").cast("bigint"))
    tags = readers.tsv(spark, f"{path}/tags.dat").select(F.col("tagID").cast("bigint"), "tagValue")
    return tagged, tags, readers.tsv(spark, f"{path}/artists.dat").select(F.col("id").cast("bigint"), "name")


@loader("lastfm")
def artists(spark: SparkSession, path: str, mode: str = "normal", hybrid_path: str | None = None, seed: int = 42) -> Tables:
    """Plays as labels with a pseudo time; with mode query_as_user, tags as users of the artists that were played."""
    plays = readers.plays(spark, f"{path}/usersha1-artmbid-artname-plays.tsv")
    docs = _text_items(plays.groupBy("item").agg(F.min("artist_name").alias("text")))
    if mode == "query_as_user":
        return {"rows": builders.artist_tag_users(*_artists(spark, hybrid_path or path), plays, seed=seed), "docs": docs}
    return {"rows": builders.artist_plays(plays), "docs": docs}


@loader("lastfm_search")
def artists_search(spark: SparkSession, path: str, min_freq: int = 50, top: int = 20) -> Tables:
    plays = readers.tsv(spark, f"{path}/user_artists.dat").select(F.col("artistID").cast("bigint"), F.col("weight").cast("bigint").alias("plays"))
    return {"rows": builders.artist_tag_pairs(*_artists(spark, path), plays, min_freq, top)}


@loader("goodbooks")
def books(spark: SparkSession, path: str, least: int = 1) -> Tables:
    book = readers.csv(spark, f"{path}/books.csv", inferSchema=True)
    return {"rows": builders.book_pairs(book, readers.csv(spark, f"{path}/book_tags.csv", inferSchema=True), readers.csv(spark, f"{path}/tags.csv", inferSchema=True), least)}


@loader("generic")
def generic(spark: SparkSession, path: str, kind: str = "csv", mapping: dict | None = None, defaults: dict | None = None, extras: list | None = None) -> Tables:
    return {"rows": readers.generic_interactions(spark, path, kind, mapping or {}, defaults, extras)}


@loader("generic_csv")
def generic_csv(spark: SparkSession, path: str, query_col: str, doc_cols: list | str, cat_col: str | None = None, id_col: str | None = None, sep: str = ",") -> Tables:
    return {"rows": readers.generic_pairs(spark, path, query_col, [doc_cols] if isinstance(doc_cols, str) else doc_cols, cat_col, id_col, sep)}


@loader("retrieval_as_user")
def folder(spark: SparkSession, path: str, mode: str = "generic", text_cols: list | None = None, item_col: str = "item", min_relevance: float = 0.8) -> Tables:
    """What retrieval as user starts from: movies with their relevant tags, or a folder's interactions and items, whose
    files are the first there of the known names."""
    if mode == "movielens_genome":
        movies = readers.csv(spark, f"{path}/movies.csv", readers.MOVIES)
        scores, names = _genome(spark, path)
        tags = interactions.relevant(scores, "relevance", min_relevance, strict=False).join(names, "tagId").select(F.col("movieId").cast("string").alias("item"), "tag", F.col("relevance").alias("weight"))
        docs = _text_items(movies.select(F.col("movieId").alias("item"), builders.movie_document().alias("text")))
        return {"rows": tags.select(F.col("tag").alias("user"), "item", F.col("weight").alias("label")), "docs": docs, "tags": tags}
    there = lambda names: next((f"{path}/{n}" for n in names if readers.exists(spark, f"{path}/{n}")), None)
    rows, items = there(readers.INTERACTION_FILES), there(readers.ITEM_FILES)
    if rows is None or items is None:
        raise FileNotFoundError(f"{path} has none of {readers.INTERACTION_FILES if rows is None else readers.ITEM_FILES}")
    found = readers.read_any(spark, items)
    columns = text_cols or [c for c in found.columns if c != item_col]
    return {"rows": readers.read_any(spark, rows), "docs": _text_items(readers.item_text(found, columns, item_col))}
