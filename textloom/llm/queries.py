"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.page_template import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.winnowing import fingerprint_table

    return fingerprint_table(table(spark, sf_dir, "documents"))


def op5_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.topk_search import search_rows

    return search_rows(table(spark, sf_dir, "documents"), every=100, k=10, query_terms=None)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import weigh

    out = weigh(table(spark, sf_dir, "documents"), columns=False)
    names = ("source", "lang", "topic", "tokens", "weight", "probability", "sampled")
    return out.select("doc_id", *(out[f"__{n}"].alias(n) for n in names))


def op9_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.privacy import find_private, spans_digest

    return spans_digest(find_private(table(spark, sf_dir, "documents")))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.context_mixing import score

    return score(table(spark, sf_dir, "documents"))


def op11_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.byte_pairs import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.spelling import spelling_variants, variant_words

    return spelling_variants(variant_words(table(spark, sf_dir, "documents"), least_size=7, every=31).where("n >= 2"), ratio=10)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict:
    from textloom.llm import chat, sql_checks

    return {"op1_chat_perspectives": chat.SQL, "op12_importance_resampling": sql_checks.IMPORTANCE, "op13_spelling_variants": sql_checks.SPELLING}
