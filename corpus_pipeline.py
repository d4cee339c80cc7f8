"""From raw documents to packed training sequences: five stages, each over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.bin_completion import pack
from palisade.llm.common import kept, read
from palisade.llm.decontamination import decontaminate
from palisade.llm.jaccard_join import keep_one_of_each
from palisade.llm.queries import byte_tokenizer
from palisade.llm.secret_scan import redact
from palisade.llm.toxicity import fit_toxicity, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled rows among them, finds toxic (0.7 and above) go. Null texts stay;
    repeated rows go or stay alike; equal scores are treated alike; texts are read whole; no documents, or no labels of
    both kinds: the starter grammar decides; all columns are kept."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return reject_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of least id stays. Rows with that id all stay, as do rows without id or
    without words; an empty table stays empty; all columns are kept."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which more than half the words are benchmark text go, exactly half
    stays. Null texts stay null; without items nothing changes; repeated rows are treated alike; the length is set anew."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks, overlapping ones by one. Null texts stay null; repeated rows are treated alike; the
    length is set anew; all other columns are kept."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in packed sequences. Null and empty texts are one piece (the end); repeated rows are
    packed each; no documents give no pieces; other columns are left out."""
    return pack(docs, byte_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The grammar, the chosen-path join and the search for packings have no SQL form; tests hold them to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = kept(docs)
    return docs
