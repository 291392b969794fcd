"""Data-set builders: compositions of operators that give interactions, pairs or candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clean_name, draw, draw_int, joined_text, not_blank, sorted_tags
from ..operators import bm25, history, interactions, splits
from ..operators.lineage import cut


# --- interactions ---------------------------------------------------------------------------------------------------
def movie_ratings(ratings: DataFrame, movies: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Ratings of users of middling activity, with titles."""
    rows = interactions.canonical(ratings, {"user": ["userId"], "item": ["movieId"], "label": ["rating"], "time": ["timestamp"]})
    kept = interactions.activity_between(interactions.sampled(rows, fraction, seed, "user", "item", "time"))
    return kept.join(movies.select(F.col("movieId").alias("item"), "title", "genres"), "item", "left")


def tag_users(scores: DataFrame, least: float = 0.8) -> DataFrame:
    """Tags as users of the movies they are relevant to; relevance is label and time."""
    rows = interactions.relevant(scores, "relevance", least, strict=True)
    return rows.select(F.col("tagId").alias("user"), F.col("movieId").alias("item"), F.col("relevance").alias("label"), F.col("relevance").alias("time"))


def product_ratings(ratings: DataFrame, fraction: float = 1.0, core: int = 10, seed: int = 42) -> DataFrame:
    rows = interactions.canonical(ratings.dropna())
    return interactions.k_core(interactions.sampled(rows, fraction, seed, "user", "item", "time"), core)


def category_users(items: DataFrame, max_items: int = 200_000, label: float = 0.8) -> DataFrame:
    """Categories as users of their products, once each, for the most frequent products."""
    rows = interactions.categories(items).select(F.col("category").alias("user"), "item").distinct()
    return interactions.popular(rows, max_items).select("user", "item", F.lit(label).alias("label"), F.lit(0).cast("bigint").alias("time"))


def artist_plays(plays: DataFrame, profiles: DataFrame | None = None, ascending: bool = True) -> DataFrame:
    rows = interactions.activity_between(interactions.canonical(plays, {"label": "plays"}))
    out = interactions.pseudo_time(rows, ascending)
    return out if profiles is None else out.join(profiles, "user", "left")


def artist_tag_users(tagged: DataFrame, tags: DataFrame, artists: DataFrame, plays: DataFrame, least: int = 2, seed: int = 42) -> DataFrame:
    """Tags as users of artists that are matched by cleaned name with the artists of the plays."""
    counts = tagged.groupBy("artistID", "tagID").agg(F.count("*").alias("n"))
    named = counts.join(tags, "tagID").join(artists.select(F.col("id").alias("artistID"), clean_name("name").alias("name")), "artistID")
    known = plays.select(F.col("item"), clean_name("artist_name").alias("name")).distinct()
    rows = named.join(known, "name").select(F.col("tagValue").alias("user"), "item", F.col("n").cast("double").alias("label"))
    return interactions.min_count(rows, "user", least).withColumn("time", draw_int(seed, "user", "item"))


# --- query-document pairs -------------------------------------------------------------------------------------------
def movie_document(title: str = "title", genres: str = "genres", tags: str | None = None):
    parts = [F.col(title), F.replace(F.col(genres), F.lit("|"), F.lit(" "))] + ([F.array_join(F.col(tags), " ")] if tags else [])
    return joined_text(*parts)


def tag_pairs(scores: DataFrame, names: DataFrame, movies: DataFrame, least: float = 0.8) -> DataFrame:
    rows = interactions.relevant(scores, "relevance", least, strict=True).join(names, "tagId", "left").join(movies, "movieId", "left")
    return rows.select(F.col("tag").alias("search_query"), movie_document().alias("document"), F.col("tag").alias("category"), F.col("movieId").cast("string").alias("document_id"))


def artist_tag_pairs(tagged: DataFrame, tags: DataFrame, artists: DataFrame, plays: DataFrame, min_freq: int = 50, top: int = 20) -> DataFrame:
    """Frequent tags with the artists they are among the top ones of, for artists that were played."""
    counts = tagged.groupBy("artistID", "tagID").agg(F.count("*").alias("n")).join(tags, "tagID")
    frequent = counts.groupBy("tagValue").agg(F.sum("n").alias("f")).where(F.col("f") >= min_freq).select("tagValue")
    best = interactions.top_per(counts.where(not_blank("tagValue")).join(frequent, "tagValue", "left_semi"), "artistID", top, F.desc("n"), "tagValue")
    played = plays.groupBy("artistID").agg(F.sum("plays").alias("p")).where("p > 0").select("artistID")
    out = best.join(artists.withColumnRenamed("id", "artistID"), "artistID").join(played, "artistID", "left_semi")
    return out.select(F.col("tagValue").alias("search_query"), F.col("name").alias("document"), F.col("tagValue").alias("category"), F.col("artistID").cast("string").alias("document_id")).distinct()


def category_pairs(items: DataFrame, least: int = 10, stop: str | None = None) -> DataFrame:
    """Categories with the products in them, for categories of enough products."""
    document = F.when(F.col("description") != "", F.concat_ws(". ", "title", "description")).otherwise(F.col("title"))
    rows = interactions.categories(items, stop=stop).select(F.col("category").alias("search_query"), document.alias("document"), "category", F.col("item").cast("string").alias("document_id")).distinct()
    return interactions.min_count(rows, "search_query", least)


def book_pairs(books: DataFrame, book_tags: DataFrame, tags: DataFrame, least: int = 1) -> DataFrame:
    rows = book_tags.where(F.col("count") >= least) if "count" in book_tags.columns else book_tags
    year = F.col("original_publication_year").cast("int").cast("string")
    met = rows.join(tags, "tag_id").join(books, rows["goodreads_book_id"] == books["book_id"])
    return met.select(F.col("tag_name").alias("search_query"), joined_text("title", "authors", year, by="\n").alias("document"), F.col("tag_name").alias("category"), F.col("book_id").cast("string").alias("document_id")).distinct()


# --- histories and candidates ---------------------------------------------------------------------------------------
def hybrid(df: DataFrame, items: DataFrame, share: float = 0.6, last: int = 40, sampled: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """History-to-next-item pairs of the first part of each user's rows, and candidate rows of the last ones."""
    parts = splits.by_ratio(df, ("train", share), ("test", 1 - share))
    base = ["user", "item", "label", "time"]
    train = parts.where("part = 'train'").select(*base)
    queries = history.half_query_truth(parts.where("part = 'test'").select(*base), last)
    return history.next_item_pairs(train, seed=seed), history.candidate_rows(queries, splits.negatives(df, items, sampled, seed))


def artist_hybrid(plays: DataFrame, artists: DataFrame, tagged: DataFrame, tags: DataFrame, share: float = 0.6, last: int = 40, sampled: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hybrid of plays (user, item, label, time), and catalogue rows: every artist's name and its tags as a
    document, which the scorers index besides what was played."""
    items = interactions.encoded(interactions.universe(plays, artists.select(F.col("id").cast("string").alias("item"))), "item", "code")
    pairs, candidates = hybrid(plays, items, share, last, sampled, seed)
    named = tagged.join(tags, "tagID").groupBy(F.col("artistID").cast("string").alias("item")).agg(F.array_join(F.array_sort(F.collect_set("tagValue")), " ").alias("t"))
    catalogue = artists.select(F.col("id").cast("string").alias("item"), "name").join(named, "item", "left").select("item", joined_text("name", "t").alias("text"))
    return pairs, candidates, catalogue


def three_parts(df: DataFrame, least: int = 5, truth: int = 20) -> DataFrame:
    """60 / 20 / 20 of each user's rows by time as train, query and truth; the truth capped."""
    # size, place and part come of one sort of the users' rows: neither a second reading for the users' counts nor a second sort for the cap
    rows = splits.by_ratio(df.where("user is not null"), ("train", 0.6), ("query", 0.2), ("truth", 0.2)).where(F.col("size") >= least)
    first = F.floor(F.col("size") * F.lit(0.6 + 0.2))
    return rows.where((F.col("part") != "truth") | (F.col("place") - first < truth))


def sampled_search(pairs: DataFrame, docs: DataFrame, positives: int = 50, negatives: int = 1000, seed: int = 42) -> DataFrame:
    """For each query its first documents as truth, and documents drawn from the rest; all of the query's positives are left out."""
    rows = pairs.select(F.col("search_query").alias("user"), F.col("document_id").alias("item")).distinct()
    truth = interactions.top_per(rows, "user", positives, "item").groupBy("user").agg(F.array_sort(F.collect_list("item")).alias("ground_truth_ids"))
    drawn = splits.negatives(rows, interactions.encoded(docs.select(F.col("document_id").alias("item")).distinct(), "item", "code"), negatives, seed)
    return history.candidate_rows(truth.withColumn("query_ids", F.array("user")), drawn)


# --- retrieval as user ----------------------------------------------------------------------------------------------
def limited(asked: DataFrame, limit: int | None, seed: int = 42) -> DataFrame:
    """At most so many of the queries, by a seeded draw of their names: a draw, not the first of the table."""
    if limit is None:
        return asked
    return asked.orderBy(draw(seed, "query"), "query").limit(limit)


def _as_users(docs: DataFrame, asked: DataFrame, text: str, k: int, dense_label: bool) -> DataFrame:
    """The k best hits of each query as the interactions of a user. `docs` has doc_id and text, `asked` query and `text`, one row a query.

    Queries of the same text are searched once, by the least of them, and documents of the same words are scored once."""
    asked = cut(asked.select(F.col("query"), F.col(text).alias("__text")))
    once = asked.groupBy("__text").agg(F.min("query").alias("query"))
    hits = bm25.retrieval_as_user(bm25.search(bm25.build(docs), docs, once, k, "query", "__text", alike=True), k, "query", dense_label)
    name = lambda c: F.concat(F.lit("retrieval::"), F.col(c).cast("string"))
    same = asked.join(once.withColumnRenamed("query", "__least"), "__text").select(name("__least").alias("__least"), name("query").alias("user"))
    return hits.withColumnRenamed("user", "__least").join(same, "__least").select("user", "item", "label", "time", "score")


def retrieval_by_tag(docs: DataFrame, tags: DataFrame, k: int = 100, per_doc: int = 30, dense_label: bool = False, query_limit: int | None = None, max_docs: int | None = None, seed: int = 42) -> DataFrame:
    """Documents (item, text) get their heaviest tags as text; each tag is a query; hits become the tag's interactions."""
    best = interactions.top_per(tags, "item", per_doc, F.desc("weight"), "tag").groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "tag"))), lambda s: s["tag"]), " ").alias("t"))
    docs = docs if max_docs is None else docs.orderBy("item").limit(max_docs)
    enriched = docs.join(best, "item", "left").select(F.col("item").alias("doc_id"), F.concat_ws(" ", "text", "t").alias("text"))
    return _as_users(enriched, limited(tags.select(F.col("tag").alias("query")).distinct(), query_limit, seed), "query", k, dense_label)


def retrieval_by_profile(df: DataFrame, docs: DataFrame, k: int = 100, items: int = 50, dense_label: bool = False, query_limit: int | None = None, seed: int = 42) -> DataFrame:
    """Each user's last items' texts are the query."""
    profiles = limited(history.profile_text(df, docs, items).select(F.col("user").alias("query"), "search_query"), query_limit, seed)
    return _as_users(docs.select(F.col("item").alias("doc_id"), "text"), profiles, "search_query", k, dense_label)


def retrieval_by_category(docs: DataFrame, categories: DataFrame, k: int = 100, least: int = 10, dense_label: bool = False, query_limit: int | None = None, seed: int = 42) -> DataFrame:
    """Categories with enough documents are the queries. `docs` has item and text, `categories` item and category."""
    asked = limited(interactions.min_count(categories, "category", least, distinct="item").select(F.col("category").alias("query")).distinct(), query_limit, seed)
    return _as_users(docs.select(F.col("item").alias("doc_id"), "text"), asked, "query", k, dense_label)


def retrieval_by_relative_tag(docs: DataFrame, weights: DataFrame, least: float = 0.8, k: int = 100, per_doc: int = 30, min_items: int = 1, query_limit: int | None = None, seed: int = 42) -> DataFrame:
    """Tag weights relative to each item's greatest, those of `least` or more, tags of enough items; then as by tag."""
    rows = interactions.relative_weight(weights, "item", "weight").where(F.col("relevance") >= least).select("item", "tag", F.col("relevance").alias("weight"))
    return retrieval_by_tag(docs, interactions.min_count(rows, "tag", min_items), k, per_doc, query_limit=query_limit, seed=seed)


def tags_of(items: DataFrame, column: str = "category") -> DataFrame:
    """item, tag, weight 1 from a list of tags."""
    return items.select("item", F.explode(sorted_tags(column)).alias("tag")).withColumn("weight", F.lit(1.0))
