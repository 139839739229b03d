"""From raw documents to packed training sequences."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.llm import exact_dedup, language_id, minhash, mixing, packing
from matchforge.llm.common import crc_mod, documents, durable
from matchforge.llm.tokenizers import path as tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or with none that is likelier than not, go: null, empty and letterless ones with them. Other columns stay as they are."""
    vocabulary = tokenizer("piece_bpe_32k.model")
    learn = docs.where(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False)))
    langs, table = language_id.train(learn, vocabulary)
    return language_id.keep_identified(docs, langs, table, vocabulary)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id stays; null counts as empty, a text of any length is compared whole, and rows that repeat id and text stay or go together."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies (five-word shingles, 80 %) the one with the least doc_id stays; a text without words is near nothing, and one of any length gives all its shingles."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice. Null is a source too; rows of one id share their fate, and all words of a text of any length count."""
    return mixing.take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of at most 1024, one row a piece. Null text is the end id alone; repeated rows are packed as often."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


STAGES: list = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Language identification and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages, each written and read again. Empty tables pass every stage; columns whose names clash with the operators' own stay apart."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
