"""One query per operator over the given tables, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paritas.llm import (
    archives,
    langid,
    line_crf,
    masked_lm,
    merkle,
    ngram_join,
    pieces,
    prefix_trie,
    pseudonyms,
    quality,
    quotes,
    tiling,
    token_counts,
)
from paritas.llm.merkle_sql import CRC32, manifest_sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.document_languages(table(spark, folder, "documents"))


def op5_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs)


def op6_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(quotes.quoting(table(spark, folder, "conversations")))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op2_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return masked_lm.log_likelihoods(docs, masked_lm.fit(docs))


def op3_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("print")


def op8_line_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_crf.line_verdicts(docs, line_crf.fit(docs, table(spark, folder, "labels")))


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), pieces.load())


def op10_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archived(table(spark, folder, "pages"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.document_token_counts(
        table(spark, folder, "documents"), token_counts.load()
    )


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_documents(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_masked_lm": op2_masked_lm,
    "op3_string_tiling": op3_string_tiling,
    "op4_language": op4_language,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_quotes": op6_quotes,
    "op7_ngram_join": op7_ngram_join,
    "op8_line_labels": op8_line_labels,
    "op9_pieces": op9_pieces,
    "op10_archives": op10_archives,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_merkle": op13_merkle,
}

#: The rest learns, hashes or tiles in ways SQL can't; it is tested against brute force.
ORACLE: dict[str, str] = {
    "op11_prefix_trie": f"""
        with own as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as txt,
                left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '')
                    || coalesce(text, '')), 32) as digest, turn
            from conversations where conv_id is not null
        ), o as (
            select *, row_number() over (partition by conv_id order by turn nulls first, digest)
                as i from own
        ), sizes as (
            select conv_id, count(*) as n from o group by conv_id
        ), ids as (
            select s.conv_id, {CRC32.format("s.conv_id::varchar")} % 9 as h,
                s.conv_id - s.conv_id % 5 as base, coalesce(b.n, 0) as base_n
            from sizes s left join sizes b on b.conv_id = s.conv_id - s.conv_id % 5
        ), rebuilt as (
            select c.conv_id, o.i as d, digest, strlen(txt) as bytes
            from ids c join o on o.conv_id = c.base where o.i <= c.h
            union all
            select c.conv_id, least(c.h, c.base_n) + o.i - c.h, digest, strlen(txt)
            from ids c join o on o.conv_id = c.conv_id where o.i > c.h
        ), path as (
            select conv_id, 0 as d, '' as key, 0 as bytes from ids
            union all
            select conv_id, d, sha256(string_agg(digest, '') over (
                partition by conv_id order by d rows unbounded preceding)), bytes
            from rebuilt
        ), steps as (
            select *, lag(key) over (partition by conv_id order by d) as above,
                lead(key) over (partition by conv_id order by d) as below
            from path
        ), nodes as (
            select key, any_value(d) as depth, any_value(above) as above, min(conv_id) as conv_id,
                count(*) as n_convs, count(distinct below) as n_children,
                (count(*) - 1) * any_value(bytes) as saved,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id)
                    filter (where below is null), '')) as ends_sha256
            from steps group by key
        ), subtrees as (
            select p.key, count(*) filter (where n.n_children = 0) as n_leaves,
                sum(n.saved) as saved_tokens
            from nodes n join path p on p.conv_id = n.conv_id and p.d <= n.depth
            group by p.key
        )
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children,
            s.n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
        from nodes n join subtrees s on s.key = n.key left join nodes p on p.key = n.above
    """,
    "op13_merkle": manifest_sql(),
    "op6_quotes": """
        with m as (
            select distinct conv_id, turn from conversations where trim(text, ' \n') <> ''
        ), t as (
            select c.conv_id, c.turn, c.role, c.text, p.turn as parent_turn
            from conversations c
            left join m p on p.conv_id = c.conv_id and p.turn = c.turn - 1
        ), r as (
            select *, max(case when parent_turn is null then turn end)
                over (partition by conv_id order by turn) as root_turn
            from t
        )
        select *, turn - root_turn as depth from r
    """,
    "op10_archives": """
        with p as (
            select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as bytes
            from pages
        ), c as (
            select html, max(page_id) as newest from p where bytes >= 1000 group by html
        )
        select p.page_id, p.bytes as payload_bytes, sha1(p.html) as payload_digest,
            case when c.newest > p.page_id then 'revisit' else 'response' end as record_type,
            case when c.newest > p.page_id then c.newest end as refers_to
        from p left join c on p.html = c.html
    """,
}
