"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.llm import (
    bpe,
    chat_examples,
    decontaminate,
    heap_kmeans,
    html_text,
    jaccard_join,
    language_id,
    lexical_search,
    quality_rules,
    rendezvous,
    token_grammar,
    toxicity,
    twins,
    url_filter,
)
from folium.llm.common import read
from folium.session import stored


def op1_url_filter(spark, sf_dir):
    """Verdict of every page's url."""
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    """Score of every document."""
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_grammar(spark, sf_dir):
    """Place, length and checksum of every document's ids, from the written shards."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_grammar.digests(read(spark, sf_dir, "documents"), path, end_id=2)


def op4_quality_rules(spark, sf_dir):
    """Ledger of every document under the current policy, from the stored bits."""
    book = stored(quality_rules.ledger(read(spark, sf_dir, "documents")))
    return quality_rules.apply_policy(book)


def op5_ngram_jaccard_join(spark, sf_dir):
    """Shingle count and class of every document."""
    return jaccard_join.joined(read(spark, sf_dir, "documents"))


def op6_chat_formatting(spark, sf_dir):
    """Digests of all conversations, and of one full of marks, from the written examples."""
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat_examples.digests(stored(chat_examples.expand(own.unionByName(trap))))


def op7_bpe(spark, sf_dir):
    """Every document encoded and decoded again."""
    import public_tokenizers

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return language_id.predicted(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op10_decontamination(spark, sf_dir):
    """Every document and benchmark item of which a stretch lies in it."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark, sf_dir):
    """Cluster and distance of every kept vector."""
    return heap_kmeans.clustered(read(spark, sf_dir, "embeddings"))


def op12_sharding(spark, sf_dir):
    """Shard and slot of every document, from the written shards."""
    return rendezvous.digests(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_token_grammar": op3_token_grammar,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {
    "op1_url_filter": twins.URL,
    "op4_quality_rules": twins.QUALITY,
    "op5_ngram_jaccard_join": twins.NEAR,
    "op6_chat_formatting": twins.CHAT,
    "op11_centroid_clustering": twins.MEANS,
    "op12_sharding": twins.SHARDS,
    "op13_lexical_search": twins.SEARCH,
}
