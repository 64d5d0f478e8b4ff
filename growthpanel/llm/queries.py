"""One query per operator over the whole of its table, and the SQL where DuckDB can repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthpanel.llm import binary_ids, chat, collocations, merkle, mixing, neighbours, packing, page_text, secret_scan, simhash, substrings, toxicity, vector_dedup
from growthpanel.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark, folder):
    return simhash.simhash_components(table(spark, folder, "documents"))


@query
def op2_neighbours(spark, folder):
    return neighbours.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_packing(spark, folder):
    return packing.pack_digest(table(spark, folder, "documents"))


@query
def op4_mixing(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_toxicity(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_vector_dedup(spark, folder):
    return vector_dedup.vector_components(table(spark, folder, "embeddings"))


@query
def op7_substrings(spark, folder):
    return substrings.repeated_digest(table(spark, folder, "documents"))


@query
def op8_token_files(spark, folder):
    return binary_ids.encode_and_read(table(spark, folder, "documents"))


@query
def op9_page_text(spark, folder):
    return page_text.extract_main_text(table(spark, folder, "pages"))


@query
def op10_secrets(spark, folder):
    return secret_scan.secret_digest(secret_scan.scan_secrets(table(spark, folder, "documents")))


@query
def op11_chat(spark, folder):
    return chat.chat_digest(table(spark, folder, "conversations"))


@query
def op12_manifest(spark, folder):
    return merkle.proof_digest(table(spark, folder, "documents"))


@query
def op13_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


ORACLE["op10_secrets"] = secret_scan.duckdb_sql()
ORACLE["op11_chat"] = chat.duckdb_sql()
ORACLE["op12_manifest"] = merkle.duckdb_sql()
ORACLE["op13_collocations"] = collocations.duckdb_sql()
