"""The given tables, seen as comments, corpora, vectors and pages.

Only binding: which column stands for what. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainspeak.functions import labels
from plainspeak.operators.frames import spread
from plainspeak.operators.vocabulary import fit_vocabulary
from plainspeak.plans.cleaning import clean_comments
from plainspeak.session import shared_folder, stored, work_path
from plainspeak.sources.comments import project_comments, stream_comments, write_comments

STOP_LIST_SIZE = 50
VECTOR_SIZE = 64



def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_folder(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def _comment_columns(rows: DataFrame, *extra: str) -> DataFrame:
    stamp = F.col("ts").cast("timestamp")
    return rows.select(
        "doc_id",
        *extra,
        (F.unix_micros(stamp) / 1e6).alias("timestamp"),
        F.col("user_id").cast("string").alias("user"),
        F.col("text").alias("comment"),
        stamp.alias("event_time"),
    )


def comments(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """One comment a document; author and time from the event of the same number."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    docs = documents(spark, folder)
    return _comment_columns(docs.join(events, F.col("doc_id") == F.col("event_id")), *extra)


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """Comments as they are captured, all text; each seventh time stamp is malformed."""
    micros = F.unix_micros("event_time")
    seconds = F.concat_ws(
        ".",
        F.floor(micros / 1000000).cast("string"),
        F.lpad(F.pmod(micros, F.lit(1000000)).cast("string"), 6, "0"),
    )
    stamp = F.when(F.col("doc_id") % 7 == 3, F.lit("bad")).otherwise(seconds)
    return comments(spark, folder).select("doc_id", "user", "comment", stamp.alias("timestamp"))


def scores(number, chars):
    """Three scores that add up to one, in sixteenths."""
    first = (F.col(chars) % 7 + 1) / 16
    second = (F.col(number) % 7 + 1) / 16
    return F.array(first, second, 1 - first - second).cast("array<float>")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = comments(spark, folder, "n_chars")
    return rows.withColumn("scores", scores("doc_id", "n_chars")).withColumn(
        "prediction", labels.argmax("scores")
    )


def class_labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, label_id: toxic is 2, else low quality is 1, else 0."""
    return table(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("label_id"),
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, label_id, prediction, scores of the labelled documents."""
    docs = table(spark, folder, "documents").select(
        "doc_id", scores("doc_id", "n_chars").alias("scores")
    )
    return class_labels(spark, folder).join(docs, "doc_id").withColumn(
        "prediction", labels.argmax("scores")
    )


def stop_list(spark: SparkSession, folder: str) -> list[str]:
    """The most frequent words of the benchmark texts, lower case."""
    words = table(spark, folder, "benchmark").select(
        F.explode(F.split(F.lower("text"), " ")).alias("word")
    )
    top = (
        words.filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(STOP_LIST_SIZE)
    )
    return [r["word"] for r in top.collect()]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text_clean: the cleaned documents."""
    cleaned = clean_comments(
        documents(spark, folder).select("doc_id", "text"), stop_list(spark, folder), "text"
    )
    return cleaned.select("doc_id", F.col("comment_clean").alias("text_clean"))


def stored_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(stored(corpus(spark, folder), "corpus"), "doc_id")


def word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """word, vec: vectors in file order stand for the benchmark's words by frequency."""
    words = fit_vocabulary(table(spark, folder, "benchmark"), "item_id", "text")
    vectors = table(spark, folder, "embeddings").select(
        (F.col("vec_id") + 1).alias("idx"), F.col("embedding").alias("vec")
    )
    return words.join(vectors, "idx").select("word", "vec")


def split_name(number: str = "doc_id"):
    part = F.col(number) % 10
    return F.when(part < 8, "Train").when(part == 8, "Dev").otherwise("Test")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, label_id, set."""
    return class_labels(spark, folder).withColumn("set", split_name())


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text_clean, label_id, set; cleaning is done for labelled documents only."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    joined = spread(docs, "doc_id").join(labelled(spark, folder), "doc_id")
    cleaned = clean_comments(joined, stop_list(spark, folder), "text")
    return cleaned.filter(~F.col("is_blank_clean")).select(
        "doc_id", F.col("comment_clean").alias("text_clean"), "label_id", "set"
    )


#: Micro-batches a stream is staged for.
STREAM_BATCHES = 4
_STAGED: dict[tuple, str] = {}


def batch_files(scan: DataFrame) -> int:
    """Files of a micro-batch: as many as the input has scan tasks, so that no file, nor the task that
    writes it, grows with the input."""
    return max(1, scan.rdd.getNumPartitions())


def _stream(spark: SparkSession, folder: str, source: str, name: str, rows, extra: str) -> DataFrame:
    """Comments as a stream of JSON files in the shared folder, written once a session."""
    fields = T._parse_datatype_string(extra)
    files = batch_files(table(spark, folder, source))
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGED:
        path = work_path(spark, name)
        write_comments(rows().repartition(STREAM_BATCHES * files, fields.fieldNames()[0]), path, extra=fields)
        _STAGED[key] = path
    return stream_comments(spark, _STAGED[key], files_per_trigger=files, extra=fields)


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Captured documents, with doc_id and n_chars."""
    return _stream(
        spark, folder, "documents", "document-inbox", lambda: comments(spark, folder, "n_chars"),
        "doc_id bigint, n_chars bigint",
    )


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored comments: the class comes from the labels table."""
    known = class_labels(spark, folder).select(
        F.col("doc_id").alias("event_id"), F.col("label_id").alias("prediction")
    )
    stamp = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").join(known, "event_id", "left").select(
        "event_id",
        (F.unix_micros(stamp) / 1e6).alias("timestamp"),
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("comment"),
        F.coalesce("prediction", F.lit(0)).alias("prediction"),
    )


_EVENT_FIELDS = "event_id bigint, prediction int"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _stream(spark, folder, "events", "event-inbox", lambda: scored_events(spark, folder), _EVENT_FIELDS)


def arrivals(spark: SparkSession, folder: str, deliver) -> None:
    """Events as they would come in: a quarter of the time span after the other, each tenth event a quarter
    late. Every part is added to an inbox, then ``deliver(stream over the inbox)`` takes in what is new."""
    rows = scored_events(spark, folder)
    first, last = table(spark, folder, "events").agg(
        F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))
    ).first()
    if first is None:
        return
    part = F.expr(f"(4 * (unix_micros(timestamp_seconds(timestamp)) - {first})) div {last - first + 1}")
    rows = rows.withColumn("part", part + (F.col("event_id") % 10 == 3).cast("int"))
    inbox, fields = work_path(spark, "arrivals"), T._parse_datatype_string(_EVENT_FIELDS)
    for k in range(5):
        write_comments(rows.filter(F.col("part") == k), inbox, extra=fields)
        deliver(stream_comments(spark, inbox, extra=fields))
