"""From raw documents to token statistics: the corpus operators as stages.

Each stage is a function of (spark, docs, sf_dir) that returns what the next one takes as docs. All
but the last return the columns of documents, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.llm import decontaminate, neardup, quality, queries, secrets, sentencepieces
from pitlane.llm.common import cut


#: Near copies share so many hundredths of their shingles of five words.
SIMILAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of the top grade than not; those with toxic words or of low quality go.

    Texts are scored beside the row they came with, so repeated rows and null ids are judged by
    their own text; a null or empty text by the thresholds alone. Without any rated text all stay.
    Further columns stay whatever their names.
    """
    model = quality.fit(docs, queries.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), queries.GRADES)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    judged = quality.judge(named, model, named.columns, text=f"c{docs.columns.index('text')}", keep_from=queries.GOOD)
    return judged.where(F.col("tail_probability") >= queries.LEAST_PROBABILITY).select(*named.columns).toDF(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row, that of the least doc_id (a null one comes last).

    Rows are judged by their own text, so of a repeated row one stays, and rows that share an id but
    not a text are apart. Rows without words (null, empty, white space) are no copies of anything and
    all stay. Further columns stay whatever their names.
    """
    return neardup.one_of_each(docs, percent=SIMILAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Each row is judged by its own text; a null, empty or wordless one stays, repeated rows and null
    ids too. Without items all stay. Further columns stay whatever their names.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = decontaminate.find_windows(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), named.columns, text=f"c{docs.columns.index('text')}")
    return decontaminate.verdicts(found, named.columns).where("not contaminated").select(*named.columns).toDF(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret's span replaced by a mark, n_chars being that of the new text.

    A row without a span is as it was, a null text and an n_chars that is off included. Repeated rows
    stay. Further columns stay whatever their names.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, n_chars = (f"c{docs.columns.index(c)}" for c in ("text", "n_chars"))
    found = secrets.scan(named, text=text, base="base", spans="spans")
    clean = secrets.redacted(F.col(text), F.col("spans"))
    length = F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars))
    return found.withColumn(text, clean).withColumn(n_chars, length).select(*named.columns).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, whether decoding gives the text back (restored), and whether the library's ids are the same (agrees).

    A row for each row; a null text counts as empty and has the end id alone. Further columns go.
    """
    out = sentencepieces.encode_decode(docs, ["doc_id", "lang", "source", "text"], queries.vocabulary_path)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"), "agrees")


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("sentencepiece", encoded),
]
#: SQL can't express the classifier; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is checkpointed once for the next one; the last one's result is not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
