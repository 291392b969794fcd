"""Scans. Schemas are given, not inferred, wherever a layout is known, so a scan is one pass."""

from __future__ import annotations

import glob
import importlib
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.scalars import clean_name, description, joined_text, not_blank, sorted_tags

# Layouts of the public files.
RATINGS = "userId bigint, movieId bigint, rating double, timestamp bigint"
MOVIES = "movieId bigint, title string, genres string"
TAG_SCORES = "movieId bigint, tagId bigint, relevance double"
TAG_NAMES = "tagId bigint, tag string"
PRODUCT_RATINGS = "item string, user string, rating double, timestamp bigint"
PLAYS = "user_name string, artist_mbid string, artist_name string, plays bigint"
PROFILES = "user_name string, gender string, age bigint, country string, signup string"
PRODUCT = "asin string, title string, description string, category array<string>, categories array<array<string>>"


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = ",", **options) -> DataFrame:
    reader = spark.read.options(header=header, sep=sep, mode="PERMISSIVE", **options)
    return (reader.schema(schema) if schema else reader).csv(path)


def headerless(spark: SparkSession, path: str, schema: str = PRODUCT_RATINGS) -> DataFrame:
    """Positional columns; rows of other lengths are padded with nulls or cut."""
    return csv(spark, path, schema, header=False)


def raw_lines(spark: SparkSession, path: str, columns: list[str], least: int) -> DataFrame:
    """Lines as runs of characters that are no separator; lines with fewer than `least` are dropped."""
    found = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r"[^,\s]+"), F.lit(0)).alias("t")).where(F.size("t") >= least)
    return found.select(*[F.get("t", i).alias(c) for i, c in enumerate(columns)])


def plays(spark: SparkSession, path: str) -> DataFrame:
    """Plays without quoting; the artist is its id or else its cleaned name; rows without user, artist or plays go."""
    rows = spark.read.schema(PLAYS).options(sep="\t", quote="", mode="PERMISSIVE").csv(path)
    artist = F.when(F.length(F.coalesce("artist_mbid", F.lit(""))) > 0, F.col("artist_mbid")).otherwise(clean_name("artist_name"))
    return rows.select(F.col("user_name").alias("user"), artist.alias("item"), "artist_name", "plays").dropna(subset=["user", "item", "plays"])


def with_profiles(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    profiles = spark.read.schema(PROFILES).options(sep="\t", quote="").csv(path)
    return df.join(profiles.withColumnRenamed("user_name", "user"), "user", "left")


def tsv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """With header; rows that do not parse are dropped (`malformed` lists them)."""
    reader = spark.read.options(header=True, sep="\t", encoding=encoding, mode="DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON lines, gzipped or not; lines that do not parse are dropped (`malformed` lists them). An archive that cannot
    be read to its end is an error: `ignoreCorruptFiles` of the session would drop the rest of it without a word."""
    reader = spark.read.options(mode="DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def malformed(spark: SparkSession, path: str, schema: str, kind: str = "json", **options) -> DataFrame:
    """The lines that do not parse, to be counted or looked at."""
    fields = f"{schema}, _corrupt_record string"
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", **{k: str(v) for k, v in options.items()}}
    parsed = {"json": F.from_json, "csv": F.from_csv}[kind]("value", fields, how)
    return spark.read.text(path).select(F.col("value").alias("line"), parsed.alias("p")).where("p._corrupt_record is not null").select("line")


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns made columns of their own, named parent.child."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, StructType):
            out += [F.col(f"`{field.name}`.`{c.name}`").alias(f"{field.name}.{c.name}") for c in field.dataType.fields]
        else:
            out.append(F.col(f"`{field.name}`"))
    return df.select(*out)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, tsv, dat, jsonl, json; anything else is csv with a header."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    kind = name.rpartition(".")[2]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("tsv", "dat"):
        return tsv(spark, path)
    if kind == "jsonl":
        return json_lines(spark, path)
    if kind == "json":
        return flattened(spark.read.option("multiLine", True).json(path))
    return csv(spark, path)


def generic_interactions(spark: SparkSession, path: str, kind: str, mapping: dict[str, str], defaults: dict[str, float] | None = None, extras: list[str] | None = None) -> DataFrame:
    """Any file to user, item, label, time by a column mapping; unmapped or missing columns take defaults."""
    df = {"csv": lambda: csv(spark, path), "parquet": lambda: spark.read.parquet(path), "ndjson": lambda: json_lines(spark, path)}[kind]()
    defaults = {"label": 1.0, "time": 0} | (defaults or {})
    types = {"user": "string", "item": "string", "label": "double", "time": "bigint"}
    out = []
    for name, kind_ in types.items():
        source = mapping.get(name, name)
        if source in df.columns:
            value = F.col(f"`{source}`").try_cast(kind_)
            out.append((F.coalesce(value, F.lit(defaults[name]).cast(kind_)) if name in defaults else value).alias(name))
        elif name in defaults:
            out.append(F.lit(defaults[name]).cast(kind_).alias(name))
        else:
            raise ValueError(f"no column for {name}")
    return df.select(*out, *[f"`{c}`" for c in extras or []])


def generic_pairs(spark: SparkSession, path: str, query: str, docs: list[str], category: str | None = None, id_column: str | None = None, sep: str = ",") -> DataFrame:
    """Query-document pairs: the document is its columns joined by line feeds; rows without either go; each once."""
    df = csv(spark, path, sep=sep)
    text = F.concat_ws("\n", *[F.col(f"`{d}`") for d in docs])
    out = df.select(
        F.col(f"`{query}`").alias("search_query"), text.alias("document"), (F.col(f"`{category}`") if category else F.lit("")).alias("category"), (F.col(f"`{id_column}`") if id_column else F.sha1(text)).alias("document_id")
    )
    return out.dropna(subset=["search_query"]).where("document != ''").distinct()


def products(spark: SparkSession, path: str) -> DataFrame:
    """Product metadata as item, title, description and clean categories."""
    df = json_lines(spark, path)
    has = set(df.columns)
    kind = df.schema["description"].dataType if "description" in has else StringType()
    nested = "category" not in has and "categories" in has
    chains = F.col("categories" if nested else "category") if ("category" in has or nested) else F.array().cast("array<string>")
    if nested and isinstance(df.schema["categories"].dataType.elementType, ArrayType):
        chains = F.flatten(chains)
    text = description("description", isinstance(kind, ArrayType)) if "description" in has else F.lit("")
    return df.where(not_blank("asin")).select(F.col("asin").alias("item"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), text.alias("description"), sorted_tags(chains).alias("category"))


def item_text(df: DataFrame, columns: list[str], key: str = "item") -> DataFrame:
    return df.select(F.col(key).alias("item"), joined_text(*columns).alias("text"))


def first_existing(folder: str, names: list[str]) -> str | None:
    """The first of the names that is a file of a local folder."""
    return next((os.path.join(folder, n) for n in names if os.path.exists(os.path.join(folder, n))), None)


# Where interactions and items are looked for, in this order.
INTERACTION_FILES = ["interactions.csv", "interactions.parquet", "ratings.csv", "ratings.parquet", "user_item.csv", "user_item.parquet"]
ITEM_FILES = ["items.csv", "items.parquet", "products.csv", "products.parquet", "metadata.csv", "metadata.parquet"]

# Data sets by folder, the files each must have, and the names it goes by.
DATASETS: dict[str, list[str]] = {
    "ml-25m": ["ratings.csv", "movies.csv", "genome-scores.csv", "genome-tags.csv", "tags.csv", "links.csv"],
    "amazonElectronics": ["ratings.csv", "meta_Electronics.json.gz"],
    "lastfm-dataset-360K": ["usersha1-artmbid-artname-plays.tsv", "usersha1-profile.tsv"],
    "lastfm-hybrid": ["artists.dat", "tags.dat", "user_taggedartists.dat", "user_artists.dat"],
}
DATASET_NAMES: dict[str, list[str]] = {
    "ml-25m": ["movielens", "movielens25m", "ml25m", "ml-25m"],
    "amazonElectronics": ["amazon", "amazonelectronics", "amazonElectronics", "amazonEletronics", "amazoneletronics"],
    "lastfm-dataset-360K": ["lastfm360k", "lastfm-360k", "lastfm_360k", "lastfm-dataset-360K"],
    "lastfm-hybrid": ["lastfm-hybrid", "lastfm_hetrec", "lastfmhetrec", "hetrec-lastfm"],
}


def plain_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def dataset_path(name: str, roots: list[str], spark: SparkSession | None = None) -> str:
    """The folder of a data set: the first root that has all of its files, as they are or in a zip archive that is
    unpacked beside it (local roots only). Nothing is downloaded."""
    key = next((k for k, names in DATASET_NAMES.items() if plain_name(name) in map(plain_name, [k, *names])), None)
    if key is None:
        raise KeyError(f"unknown data set {name}")
    there = (lambda f: exists(spark, f)) if spark else os.path.exists
    for root in roots:
        for folder in (f"{root}/{key}", f"{root}/{name}", root):
            if all(there(f"{folder}/{f}") for f in DATASETS[key]):
                return folder
        for archive in sorted(glob.glob(f"{root}/**/{key}.zip", recursive=True)):
            with zipfile.ZipFile(archive) as z:
                if found := _inside(z.namelist(), DATASETS[key]):
                    z.extractall(root)
                    return os.path.join(root, found) if found != "." else root
    raise FileNotFoundError(f"{name}: {', '.join(DATASETS[key])} in none of {roots}")


def _inside(names: list[str], files: list[str]) -> str | None:
    """The folder of an archive that has all the files."""
    folders = {os.path.dirname(n) for n in names if not n.startswith("/") and ".." not in n.split("/")}
    return next((f or "." for f in sorted(folders) if all((f"{f}/{x}" if f else x) in names for x in files)), None)


LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str) -> Callable:
    """Registers a loader under a name, whatever its case."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOADERS[plain_name(name)] = f
        return f

    return add


def get_loader(name: str) -> Callable[..., DataFrame]:
    """A registered loader, or the function at a dotted path."""
    if plain_name(name) in LOADERS:
        return LOADERS[plain_name(name)]
    module, _, attribute = name.rpartition(".")
    if not module:
        raise KeyError(f"unknown loader {name}; there are {sorted(LOADERS)}")
    return getattr(importlib.import_module(module), attribute)


def materialised(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """A Parquet copy, written the first time."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric rows of several runs' CSV files; the run is the number in the file's name."""
    rows = spark.read.option("header", True).schema("Model string, K int, Metric string, Value double").csv(pattern)
    return rows.withColumn("RunId", F.regexp_extract(F.input_file_name(), r"run_?(\d+)", 1)).select("RunId", "Model", "K", "Metric", "Value")
