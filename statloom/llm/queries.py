"""Queries of the problems on texts and names (2, 4, 7, 8, 9) over their whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import chunking, linkage, names, packing, tokenizer
from statloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_names(table(spark, d, "key_stats"), table(spark, d, "teams_cleaned"))


def p2_persons(spark: SparkSession, d: str) -> DataFrame:
    """The person and club of every record."""
    return names.link_names(table(spark, d, "key_stats"), table(spark, d, "teams_cleaned"))[0]


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The match of every listing, with its confidence."""
    return linkage.link_games(table(spark, d, "matches_cleaned"), table(spark, d, "teams_cleaned"), table(spark, d, "fixture_listings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("match_id", "listing_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts from their ids again."""
    return tokenizer.decode(tokenizer.encode(table(spark, d, "documents")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The place of every document in a container of 2,048 tokens."""
    docs = table(spark, d, "documents")
    shards = max(1, -(-docs.count() // packing.SHARD))
    return packing.pack(tokenizer.token_counts(docs), shards=shards)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p8_packed(spark, d))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All documents as pieces of at most 512 tokens with 64 repeated."""
    return chunking.split_texts(table(spark, d, "documents"))


QUERIES = {"p4_found": p4_found, "p4_links": p4_links, "p2_found": p2_found, "p2_persons": p2_persons, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_packed": p8_packed, "p8_containers": p8_containers, "p9_pieces": p9_pieces}
ORACLE = {"p7_decoded": "select doc_id, coalesce(text, '') as text from documents"}
