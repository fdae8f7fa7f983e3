"""The operators' queries over whole tables, and their SQL where SQL can say it.

Cases. Nulls, empty and very long texts, repeated rows, empty tables and further columns are the operators' to define: see each module. A query adds nothing
but the table that its operator is applied to; an empty table gives no rows and the same columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callweave.llm import ann, chat, lattice, lm, minhash, packing, pieces, pii, quality, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations and the model's own encoding of every text, with ids."""
    return pieces.coded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, fold and predicted label of every document."""
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-copies of every document and whether it stays."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, stated rule and verdict of every page."""
    return urls.judged(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, unigram score and the model's score of every document."""
    return lm.scored(_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best other rows of each row whose id 20 divides."""
    table = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(table, table.where("vec_id % 20 = 0"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, and all selected spans, of every document."""
    return pii.found(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of each piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it stays of every vector."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.rendered(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_sample_pieces, op2_quality, op3_near_copies, op4_urls, op5_language_model, op6_neighbours, op7_personal_data, op8_packing, op9_near_vectors, op10_chat)}

_TURNS = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place,
         coalesce('=' || role, '-') as r, coalesce('=' || text, '-') as x, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as line
  from conversations),
c as (select conv_id, count(*) as n_turns, list([r, x] order by place) as turns, string_agg(line, '' order by place) as chat from t group by conv_id),
p as (select distinct list_slice(turns, 1, k) as prefix from (select turns, n_turns, unnest(range(1, n_turns)) as k from c))
"""
ORACLE_SQL = {
    "op10_chat": _TURNS
    + """
select min(conv_id) as conv_id, n_turns, any_value(chat) as chat from c where not exists (select 1 from p where p.prefix = c.turns) group by turns, n_turns""",
}
