"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, codes, decontaminate, exact, html, minhash, mix, njoin, quality, secrets, shard, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "op1_decontamination": lambda s, d: decontaminate.op1_decontamination(t(s, d, "documents"), t(s, d, "benchmark")),
        "op2_secrets": lambda s, d: secrets.op2_secrets(t(s, d, "documents")),
        "op3_ngram_jaccard": lambda s, d: njoin.op3_ngram_jaccard(t(s, d, "documents")),
        "op4_mix": lambda s, d: mix.op4_mix(t(s, d, "documents")),
        "op5_quality": lambda s, d: quality.op5_quality(t(s, d, "documents"), t(s, d, "labels")),
        "op6_toxicity": lambda s, d: toxicity.op6_toxicity(t(s, d, "documents"), t(s, d, "labels")),
        "op7_url_filter": lambda s, d: urls.op7_url_filter(t(s, d, "pages")),
        "url_rules": lambda s, d: urls.ruled(t(s, d, "pages")),
        "op8_html_extraction": lambda s, d: html.op8_html_extraction(t(s, d, "pages")),
        "op9_exact_dedup": lambda s, d: exact.op9_exact_dedup(t(s, d, "documents")),
        "op10_sharding": lambda s, d: shard.op10_sharding(t(s, d, "documents")),
        "op11_minhash_dedup": lambda s, d: minhash.op11_minhash_dedup(t(s, d, "documents")),
        "op12_token_alignment": lambda s, d: align.op12_token_alignment(t(s, d, "documents")),
        "op13_vector_codes": lambda s, d: codes.op13_vector_codes(t(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"url_rules": urls.RULES_SQL, "op3_ngram_jaccard": njoin.OP3_SQL, "op9_exact_dedup": exact.OP9_SQL, "op11_minhash_dedup": minhash.OP11_SQL, "op13_vector_codes": codes.OP13_SQL}
