"""The registered queries: each operator over the given tables, whole."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainspeak.functions import labels
from plainspeak.functions import text as X
from plainspeak.functions.fixed_values import VECTOR_VOCABULARY_LIMIT
from plainspeak.operators import (
    ids, metrics, pages, panels, phrases, segmentation, sketches, splits, stop_words, tfidf,
)
from plainspeak.operators.frames import compute_once
from plainspeak.operators.id_log import IdLog
from plainspeak.operators.vocabulary import embedding_matrix, encode, fit_vocabulary, pool_vectors
from plainspeak.plans import cleaning, training
from plainspeak.plans.epochs import fit_epochs
from plainspeak.plans.scoring import from_scores, shipped_model
from plainspeak.session import folder_names, stored, work_path
from plainspeak.sources import artifacts, intake, lists
from plainspeak.sources import comments as capture
from plainspeak.sources import corpus as corpora
from plainspeak.streaming import aggregates, sinks
from plainspeak.streaming.board import Board
from plainspeak.streaming.progress import ProgressLog
from plainspeak.streaming.summaries import Summaries
from plainspeak.streaming.timeline import Timeline

from . import tables as t

QUERIES = {}


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t.prepare(spark)
        return function(spark, folder)

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


def _joined(array):
    return F.array_join(array.cast("array<string>"), ",")


def _rounded(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


# --- projections and filters ---------------------------------------------------


@query
def comments_projection(spark, folder):
    return capture.project_comments(t.captured(spark, folder)).select(
        "doc_id", "timestamp", "user", "comment"
    )


@query
def clean_nonempty(spark, folder):
    return cleaning.normalise_comments(t.documents(spark, folder), "text").select("doc_id")


@query
def nonblank_guard(spark, folder):
    padded = t.comments(spark, folder).select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.lit(" \t"))
        .otherwise(F.concat(F.lit(" "), F.col("user"), F.lit(" ")))
        .alias("user"),
        F.concat(F.lit("\n "), F.col("comment"), F.lit("  ")).alias("comment"),
    )
    return capture.guard_blank(padded)


@query
def label_validity(spark, folder):
    number = F.col("doc_id") % 6
    text = (
        F.when(number == 0, F.lit("1.0"))
        .when(number == 1, F.lit("x"))
        .when(number == 2, F.concat(F.lit(" "), F.col("label_id").cast("string"), F.lit(" ")))
        .when(number == 3, (F.col("label_id") + 1).cast("string"))
        .otherwise(F.col("label_id").cast("string"))
    )
    return corpora.keep_valid_labels(
        t.class_labels(spark, folder).select("doc_id", text.alias("label_id"))
    )


@query
def label_names(spark, folder):
    code = F.col("quality") + 2 * F.col("toxic")
    return t.table(spark, folder, "labels").select(
        "doc_id",
        code.alias("code"),
        labels.label_name(code).alias("name"),
        labels.label_capitals(code).alias("capitals"),
    )


@query
def label_status(spark, folder):
    code = F.col("quality") + 2 * F.col("toxic")
    name = labels.label_name(code)
    return t.table(spark, folder, "labels").select(
        "doc_id", name.alias("label"), labels.label_status(name).alias("status")
    )


@query
def time_labels(spark, folder):
    return panels.time_labels(t.scored(spark, folder)).select(
        "doc_id", "label", "date_time", "date", "time"
    )


# --- cleaning -------------------------------------------------------------------


@query
def clean_comments(spark, folder):
    return cleaning.normalise_comments(t.documents(spark, folder), "text").select(
        "doc_id", "comment_norm"
    )


@query
def emoji_strip(spark, folder):
    """Every third text gets emoji inside and outside the ranges."""
    text = F.when(
        F.col("doc_id") % 3 == 0,
        F.concat(F.lit("\U0001f600\U0001f600"), F.col("text"), F.lit("\U0001f680 \U0001f923")),
    ).otherwise(F.col("text"))
    docs = t.documents(spark, folder).select("doc_id", text.alias("marked"))
    return docs.select("doc_id", X.strip_emoji("marked").alias("text"))


@query
def stopword_filter(spark, folder):
    listed = t.stop_list(spark, folder)
    return t.documents(spark, folder).select(
        "doc_id", X.drop_stop_words("text", listed).alias("text")
    )


@query
def stopword_join(spark, folder):
    """The other way: every distinct word of the benchmark is a stop word, joined."""
    listed = stored(
        t.table(spark, folder, "benchmark").select(F.explode(X.words("text")).alias("word")).distinct(),
        "stop-words",
    )
    docs = t.documents(spark, folder).select("doc_id", "text")
    return stop_words.remove_stop_words_by_join(docs, listed, "doc_id", "text")


@query
def preprocess(spark, folder):
    return t.corpus(spark, folder)


# --- vocabulary -------------------------------------------------------------------


@query
def vocab_rank(spark, folder):
    return fit_vocabulary(t.corpus(spark, folder), "doc_id", "text_clean")


@query
def encode_pad(spark, folder):
    docs = t.stored_corpus(spark, folder)
    vocabulary = fit_vocabulary(docs, "doc_id", "text_clean")
    encoded = encode(docs, vocabulary, "doc_id", "text_clean")
    return encoded.select("doc_id", _joined(F.col("encoded")).alias("encoded"))


@query
def encode_unknown(spark, folder):
    """Documents encoded with the vocabulary of the benchmark: most words are unknown."""
    words = fit_vocabulary(t.table(spark, folder, "benchmark"), "item_id", "text")
    encoded = encode(t.documents(spark, folder), words, "doc_id", "text")
    return encoded.select("doc_id", _joined(F.col("encoded")).alias("encoded"))


@query
def one_hot_label(spark, folder):
    hot = labels.one_hot("label_id")
    return t.class_labels(spark, folder).select(
        "doc_id", "label_id", _joined(F.transform(hot, lambda v: v.cast("int"))).alias("one_hot")
    )


@query
def embedding_matrix_rows(spark, folder):
    words = fit_vocabulary(t.corpus(spark, folder), "doc_id", "text_clean")
    matrix = embedding_matrix(words, t.word_vectors(spark, folder), t.VECTOR_SIZE, padding=True)
    millionths = F.transform(
        "vec", lambda v: F.round(v.cast("double") * 1000000).cast("bigint")
    )
    return matrix.select("idx", "word", _joined(millionths).alias("vec"))


QUERIES["embedding_matrix"] = QUERIES.pop("embedding_matrix_rows")


@query
def pooled_vectors(spark, folder):
    docs = t.stored_corpus(spark, folder)
    words = fit_vocabulary(docs, "doc_id", "text_clean")
    matrix = embedding_matrix(words, t.word_vectors(spark, folder), t.VECTOR_SIZE)
    pooled = pool_vectors(docs, words, matrix, "doc_id", "text_clean", t.VECTOR_SIZE)
    return pooled.select(
        "doc_id", "n_words", F.posexplode(F.arrays_zip("mean", "max")).alias("dim", "v")
    ).select(
        "doc_id",
        "n_words",
        "dim",
        _rounded(F.col("v.mean")).alias("mean"),
        _rounded(F.col("v.max")).alias("max"),
    )


@query
def tfidf_weights(spark, folder):
    docs = t.stored_corpus(spark, folder)
    return tfidf.term_weights(docs, "doc_id", "text_clean").select(
        "doc_id", "term", "tf", _rounded(F.col("tfidf")).alias("tfidf")
    )


QUERIES["tfidf"] = QUERIES.pop("tfidf_weights")


@query
def phrase_lexicon(spark, folder):
    docs = stored(t.corpus(spark, folder), "corpus")
    return phrases.fit_phrases(t.spread(docs, "doc_id"), "text_clean").select(
        "a", "b", "n", _rounded(F.col("score")).alias("score")
    )


@query
def phrase_join(spark, folder):
    docs = t.stored_corpus(spark, folder)
    lexicon = stored(phrases.fit_phrases(docs, "text_clean"), "lexicon")
    return phrases.join_phrases(docs, lexicon, "doc_id", "text_clean")


@query
def preprocess_phrases(spark, folder):
    """The whole chain: normalise, join compound words, stop words, emoji, lower case."""
    docs = t.documents(spark, folder).select("doc_id", "text")
    normal = stored(cleaning.normalise_comments(docs, "text").drop("text"), "normal")
    lexicon = stored(phrases.fit_phrases(t.spread(normal, "doc_id"), "comment_norm"), "lexicon")
    cleaned = cleaning.clean_with_phrases(
        t.spread(normal, "doc_id"), lexicon, "doc_id", t.stop_list(spark, folder)
    )
    return cleaned.select("doc_id", F.col("comment_clean").alias("text_clean"))


@query
def segment_words(spark, folder):
    """Every cleaned document divided into words of one or more syllables, the words learned from all of them."""
    docs = t.stored_corpus(spark, folder)
    model = segmentation.fit_words(docs, "text_clean")
    return segmentation.segment_texts(docs, model, "doc_id", "text_clean")


# --- scores and panels ---------------------------------------------------------------


@query
def argmax_label(spark, folder):
    return t.table(spark, folder, "documents").select(
        "doc_id", labels.argmax(t.scores("doc_id", "n_chars")).alias("prediction")
    )


@query
def scored_comments(spark, folder):
    """The scored-comment table: timestamp, user, comment, prediction."""
    return from_scores(t.scored(spark, folder))


@query
def label_counts(spark, folder):
    return panels.label_counts(t.scored(spark, folder))


@query
def label_counters(spark, folder):
    return panels.label_counters(t.scored(spark, folder))


@query
def distinct_users(spark, folder):
    return panels.distinct_users(t.scored(spark, folder))


@query
def label_by_minute(spark, folder):
    return panels.label_by_minute(t.scored(spark, folder))


@query
def recent_comments(spark, folder):
    return panels.recent_comments(t.scored(spark, folder))


@query
def top_words(spark, folder):
    return panels.top_words(t.documents(spark, folder), comment="text")


# --- corpus statistics -----------------------------------------------------------------


def _tagged(spark, folder):
    parts = t.labelled(spark, folder)
    return [
        corpora.tag_split(parts.filter(F.col("set") == name).select("doc_id", "label_id"), name)
        for name in ("Train", "Dev", "Test")
    ]


@query
def split_label_counts(spark, folder):
    return splits.label_counts_by_split(corpora.combine(*_tagged(spark, folder)))


@query
def resplit_label_counts(spark, folder):
    return splits.label_counts_after_resplit(corpora.combine(*_tagged(spark, folder)))


@query
def split_row_counts(spark, folder):
    """Rows by split after cleaning."""
    return splits.rows_by_split(t.labelled_corpus(spark, folder))


@query
def train_dev_union(spark, folder):
    """Two corpora of one schema, by position."""
    first = (
        t.table(spark, folder, "documents")
        .join(t.class_labels(spark, folder), "doc_id")
        .select(F.col("text").alias("free_text"), "label_id")
    )
    second = t.table(spark, folder, "conversations").select(
        F.col("text").alias("free_text"),
        F.when(F.col("role") == "user", 0).otherwise(1).alias("label_id"),
    )
    return corpora.combine_by_position(first, second)


@query
def unseen_ids(spark, folder):
    """Ids linked on the pages that are not among the words of the benchmark."""
    linked = pages.link_ids(t.spread(t.table(spark, folder, "pages"), "page_id"))
    seen = t.table(spark, folder, "benchmark").select(F.explode(X.words("text")).alias("id"))
    return ids.unseen_ids(linked, seen)


@query
def intake_cap(spark, folder):
    rows = t.comments(spark, folder).select("doc_id", "timestamp", "user", "comment")
    return capture.intake_cap(rows, 100, "doc_id")


# --- metrics -------------------------------------------------------------------------------


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(t.judged(spark, folder))


@query
def accuracy(spark, folder):
    return metrics.accuracy(t.judged(spark, folder)).select(_rounded(F.col("accuracy")).alias("accuracy"))


@query
def f1_micro(spark, folder):
    return metrics.f1_micro(t.judged(spark, folder)).select(_rounded(F.col("f1_micro")).alias("f1_micro"))


@query
def f1_macro(spark, folder):
    return metrics.f1_macro(t.judged(spark, folder)).select(_rounded(F.col("f1_macro")).alias("f1_macro"))


@query
def log_loss(spark, folder):
    return metrics.log_loss(t.judged(spark, folder)).select(
        _rounded(F.col("loss")).alias("loss"), _rounded(F.col("accuracy")).alias("accuracy")
    )


# --- pages ------------------------------------------------------------------------------------


@query
def link_ids(spark, folder):
    return pages.link_ids(t.spread(t.table(spark, folder, "pages"), "page_id"))


@query
def page_blocks(spark, folder):
    return pages.page_blocks(t.spread(t.table(spark, folder, "pages"), "page_id"))


# --- streams -----------------------------------------------------------------------------------


@query
def stream_append(spark, folder):
    """Append to a table, then SQL over it."""
    raw = t.document_stream(spark, folder).select("doc_id", "timestamp", "user", "comment")
    view = f"live_{work_path(spark, 'x').rsplit('-', 1)[1]}"
    sinks.run_to_table(raw, "stream-append").createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {view}")


@query
def stream_clean(spark, folder):
    listed = t.stop_list(spark, folder)
    cleaned = cleaning.clean_comments(t.document_stream(spark, folder), listed)
    return sinks.run_to_table(
        cleaned.select("doc_id", "comment_norm", "comment_clean", "is_blank_clean"), "stream-clean"
    )


@query
def stream_label_counts(spark, folder):
    counts = aggregates.running_label_counts(t.event_stream(spark, folder))
    return sinks.run_to_table(counts, "stream-labels", "complete")


@query
def stream_label_by_minute(spark, folder):
    counts = aggregates.minute_counts(t.event_stream(spark, folder))
    return sinks.run_to_table(counts, "stream-minutes", "complete")


@query
def stream_timeline(spark, folder):
    """Minutes of the rows in time, rows too late for the policy, and both together."""
    line = Timeline(spark, work_path(spark, "timeline"), delay=timedelta(days=3))
    t.arrivals(spark, folder, lambda stream: sinks.finish(line.start(stream, every=None)))
    counts = ["minute", "clean", "offensive", "hate"]
    one = [F.count_if(F.col("prediction") == code).alias(name) for code, name in enumerate(counts[1:])]
    kinds = {"in time": line.minutes(), "all": line.minutes(with_late=True)}
    result = None
    for kind, frame in kinds.items():
        rows = frame.select(F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("event_id"), *counts)
        result = rows if result is None else result.unionByName(rows)
    late = line.late_rows()
    if late is None:
        return result
    minute = F.date_trunc("minute", "event_time").alias("minute")
    rows = late.groupBy("event_id", minute).agg(*one).withColumn("kind", F.lit("late"))
    return result.unionByName(rows)


@query
def stream_users(spark, folder):
    """The sketch after the last batch next to the exact number, and whether it is within three times
    its stated error of 5 %."""
    users = sinks.run_to_table(
        aggregates.running_users(t.event_stream(spark, folder)), "stream-users", "complete"
    )
    exact = panels.distinct_users(t.table(spark, folder, "events").select(F.col("user_id").alias("user")))
    near = F.abs(F.col("count_user") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.15 * F.col("exact"))
    # Both sides are a single row.
    both = users.withColumn("one", F.lit(1)).join(
        exact.select(F.col("count_user").alias("exact"), F.lit(1).alias("one")), "one"
    )
    return both.select(F.col("exact").cast("bigint").alias("count_user"), near.alias("near"))


@query
def users_by_range(spark, folder):
    """Users of each seven days: exact, from users as they are new in a minute of the stream, and whether the
    count by sketches a minute is within three times its error of 1.6 %."""
    seen = sinks.run_to_table(aggregates.new_users(t.event_stream(spark, folder), "400 days"), "new-users")
    days = seen.select(F.to_date("minute").alias("minute"), "user").distinct()
    exact = sketches.rolling(days, 7).groupBy("first_day").agg(
        (F.count_distinct("user") + F.max(F.col("user").isNull().cast("int"))).alias("count_user")
    )
    events = t.scored_events(spark, folder).withColumn("event_time", F.timestamp_seconds("timestamp"))
    minutes = sketches.user_sketches(events, sketches.bucket())
    daily = sketches.merge_users(minutes, sketches.bucket("minute", "day"))
    about = sketches.count_users(sketches.rolling(daily, 7, "day"), F.col("first_day"))
    error = F.abs(F.col("about") - F.col("count_user"))
    return exact.join(about.withColumnRenamed("count_user", "about"), "first_day", "left").select(
        "first_day", "count_user", F.coalesce(error <= F.greatest(F.lit(1.0), 0.05 * F.col("count_user")), F.lit(False)).alias("near")
    )


@query
def top_words_sketch(spark, folder):
    """The exact most frequent words, and whether the sketches of the stream hold each within their bound."""
    kept = Summaries(spark, work_path(spark, "summaries"))
    sinks.finish(kept.start(t.document_stream(spark, folder), every=None))
    about = kept.top_words(sketches.WORDS_TRACKED).withColumnRenamed("size", "about")
    exact = panels.top_words(t.comments(spark, folder))
    within = F.col("about").between(F.col("size"), F.col("size") + F.col("bound"))
    return exact.join(about, "text", "left").select("text", "size", F.coalesce(within, F.lit(False)).alias("within"))


@query
def stream_bad_records(spark, folder):
    """Events as JSON lines, each fiftieth cut off: records, dead letters, and whether the inbox is empty after."""
    inbox, out, archive = (work_path(spark, name) for name in ("bad-inbox", "bad-taken", "bad-archive"))
    fields = F.struct("event_id", "user", "comment", F.col("timestamp").cast("string").alias("timestamp"))
    cut = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 50 == 7, cut).otherwise(F.to_json(fields))
    files = t.batch_files(t.table(spark, folder, "events"))
    lines = t.scored_events(spark, folder).repartition(t.STREAM_BATCHES * files, "event_id").select(line.alias("value"))
    lines.write.text(inbox)
    stream = intake.stream_inbox(
        spark, inbox, archive, files, t.T._parse_datatype_string("event_id bigint")
    )
    intake.take_all(stream, out, archive)
    empty = not [n for n in folder_names(spark, inbox) if n.startswith("part-")]
    none = F.lit(None).cast("string")
    records = intake.taken(stream, out).select("event_id", "user", "comment", none.alias("line"))
    broken = intake.dead_letters(stream, out).select(
        F.lit(None).cast("bigint").alias("event_id"), none.alias("user"), none.alias("comment"), F.col("broken").alias("line")
    )
    return records.unionByName(broken).withColumn("inbox_empty", F.lit(empty))


@query
def stream_progress(spark, folder):
    """Rows that the micro-batches of a query reported, and whether there were several."""
    out = work_path(spark, "progress")
    name = out.rsplit("/", 1)[1]
    with ProgressLog(spark, f"{out}/log", {name}) as log:
        running = sinks.append_table(t.event_stream(spark, folder), out, every=None, name=name)
        sinks.finish(running)
        log.wait(running)
    return log.table().agg(F.sum("rows").alias("rows"), (F.count_distinct("batch") > 1).alias("several"))


@query
def stream_dedup(spark, folder):
    """The delay spans the whole table, so each pair of user and comment passes once."""
    once = aggregates.drop_repeats(t.event_stream(spark, folder), "400 days")
    return sinks.run_to_table(once.select("user", "comment"), "stream-dedup")


@query
def stream_snapshot(spark, folder):
    """The live board over the document stream: score, deliver, merge panels."""

    def score(batch):
        cleaned = compute_once(batch, "comment_norm", X.normalise("comment"))
        return from_scores(
            cleaned.withColumn("scores", t.scores("doc_id", "n_chars")), "comment_norm"
        )

    board = Board(spark, work_path(spark, "board"), score)
    sinks.finish(board.start(t.document_stream(spark, folder), every=None))
    return board.snapshot()


# --- models --------------------------------------------------------------------------------------


def _text_model(name):
    def run(spark, folder):
        data = stored(t.labelled_corpus(spark, folder), "labelled")
        test = data.filter(F.col("set") == "Test")
        model = training.fit(name, data.filter(F.col("set") != "Test"))
        return training.predictions(model, test).select("doc_id", "label_id", "prediction")

    return run


def _judged_model(spark, folder, name, fit, data=None, judged="Test"):
    """One row about a fitted model: test rows, those with a class of 0-2, whether it beats the commonest
    class of the rows ``judged`` (the fit sees the training rows only), whether it predicts the same after saving and loading, and whether its
    loss on the validation part is finite. Only comparisons leave, so SQL can say what they have to be."""
    if data is None:
        data = t.spread(stored(t.labelled_corpus(spark, folder), "labelled"), "doc_id")
    parts = {part: stored(data.filter(F.col("set") == part), f"part-{part}") for part in ("Train", "Dev", "Test")}
    model = fit(parts["Train"])
    path = work_path(spark, "model")
    artifacts.save_model(model, path)
    loaded = artifacts.load_model(path)
    known = training.predictions(model, parts[judged])
    hits = known.agg(
        F.sum((F.col("prediction") == F.col("label_id")).cast("int")),
        *[F.count_if(F.col("label_id") == c) for c in (0, 1, 2)],
    ).first()
    test = training.predictions(model, parts["Test"]).select("doc_id", "prediction")
    again = training.predictions(loaded, parts["Test"]).select("doc_id", F.col("prediction").alias("again"))
    loss = training.validate(model, parts["Dev"]).first()["loss"]
    return test.join(again, "doc_id").agg(
        F.lit(name).alias("model"),
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.col("prediction").isin(0, 1, 2)).alias("in_classes"),
        F.lit(hits[0] > max(hits[1:])).alias("beats_commonest"),
        (F.count_if(F.col("prediction") != F.col("again")) == 0).alias("same_after_loading"),
        F.lit(loss is None or math.isfinite(loss)).alias("finite_loss"),
    )


def _judged_text_model(name, judged):
    def run(spark, folder):
        return _judged_model(spark, folder, name, lambda rows: training.fit(name, rows), judged=judged)

    return run


_nb = _text_model("naive_bayes")
_nb.__name__ = "model_nb"
query(_nb)
# Logistic regression has a weight for each of 262,144 words and no penalty: on the few test rows of the small
# tables it doesn't beat the commonest class, so only its fit to the training rows is judged.
for _key, _name, _judged in (
    ("model_lr", "logistic_regression", "Train"),
    ("model_dt", "decision_tree", "Test"),
    ("model_rf", "random_forest", "Test"),
):
    _run = _judged_text_model(_name, _judged)
    _run.__name__ = _key
    query(_run)


@query
def model_mlp(spark, folder):
    """Pooled word vectors into a small dense network, validated on a part that the fit doesn't see."""
    data = t.spread(stored(t.labelled_corpus(spark, folder), "labelled"), "doc_id")
    train = data.filter(F.col("set") == "Train")
    features = training.VectorFeatures.fit(train, t.word_vectors(spark, folder), "doc_id", "text_clean", t.VECTOR_SIZE)
    return _judged_model(
        spark, folder, "word_vectors",
        lambda rows: training.fit_prepared_vectors(features, rows),
        stored(features.transform(data, "doc_id", "text_clean").drop("text_clean"), "pooled-all"),
    )


@query
def model_epochs(spark, folder):
    """The dense classifier fitted in epochs: straight, and stopped after the first epoch and taken up again."""
    data = t.spread(stored(t.labelled_corpus(spark, folder), "labelled"), "doc_id")
    train = data.filter(F.col("set") == "Train")
    features = training.VectorFeatures.fit(train, t.word_vectors(spark, folder), "doc_id", "text_clean", t.VECTOR_SIZE)
    used = features.transform(data.filter(F.col("set").isin("Train", "Dev")), "doc_id", "text_clean")
    used = stored(used.drop("text_clean"), "pooled-all")
    parts = {part: stored(used.filter(F.col("set") == part), f"part-{part}") for part in ("Train", "Dev")}
    inputs, paths = 2 * t.VECTOR_SIZE, [work_path(spark, "epochs") for _ in range(2)]
    straight = fit_epochs(parts["Train"], parts["Dev"], paths[0], inputs, epochs=3)
    fit_epochs(parts["Train"], parts["Dev"], paths[1], inputs, epochs=1)
    resumed = fit_epochs(parts["Train"], parts["Dev"], paths[1], inputs, epochs=3)
    again = training.validate(straight.model, parts["Dev"]).first()["loss"]
    both = straight.history.join(resumed.history.withColumnRenamed("loss", "other"), "epoch")
    near = F.coalesce(F.abs(F.col("loss") - F.col("other")) < 1e-6, F.col("loss").isNull() & F.col("other").isNull())
    least = F.coalesce(F.abs(F.min("loss") - F.lit(again)) < 1e-9, F.lit(again is None))
    told = both.agg(F.count(F.lit(1)).alias("epochs"), F.every(near).alias("same_after_stop"), least.alias("best_is_least"))
    return parts["Dev"].agg(F.count(F.lit(1)).alias("dev_rows")).join(F.broadcast(told))


@query
def model_array(spark, folder):
    """Every document encoded and scored by an array model from a file: the class shares, in thousandths, of the
    words in the training rows, summed over the encoded words."""
    docs = t.stored_corpus(spark, folder)
    vocabulary = fit_vocabulary(docs, "doc_id", "text_clean")
    encoded = stored(encode(docs, vocabulary, "doc_id", "text_clean"), "encoded")
    train = encoded.join(t.labelled(spark, folder).filter(F.col("set") == "Train"), "doc_id")
    seen = train.select("label_id", F.explode("encoded").alias("idx")).filter(f"idx > 0 AND idx < {VECTOR_VOCABULARY_LIMIT}")
    shares = [F.expr(f"1000 * count_if(label_id = {c}) div count(*)").alias(f"w{c}") for c in (0, 1, 2)]
    weights = np.zeros((VECTOR_VOCABULARY_LIMIT, 3), np.int64)
    for r in seen.groupBy("idx").agg(*shares).collect():  # fewer rows than VECTOR_VOCABULARY_LIMIT
        weights[r["idx"]] = r["w0"], r["w1"], r["w2"]
    path = os.path.join(tempfile.mkdtemp(prefix="plainspeak-"), f"shares-{uuid.uuid4().hex}.npy")
    np.save(path, weights)

    def load(local):
        known = np.load(local)

        def predict(batch):
            ids = np.asarray(batch).astype(np.int64)
            return known[np.where(ids < len(known), ids, 0)].sum(axis=1).astype(np.float32)

        return predict

    scored = shipped_model(spark, path, load, encoded="encoded")(encoded)
    return scored.select(
        "doc_id", labels.argmax("scores").alias("prediction"),
        _joined(F.transform("scores", lambda s: s.cast("int"))).alias("scores"),
    )


# --- sources and sinks, there and back -------------------------------------------------------------


@query
def csv_corpus(spark, folder):
    """Documents through a CSV corpus: quotes and line breaks survive, other labels become NULL."""
    path = work_path(spark, "csv")
    label = F.when(F.col("doc_id") % 5 == 4, F.lit("x")).otherwise((F.col("doc_id") % 5).cast("string"))
    rows = t.documents(spark, folder).select(F.concat(F.lit('say "a, b"\n'), "text").alias("free_text"), label.alias("label_id"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return corpora.read_corpus(spark, path)


@query
def stop_word_file(spark, folder):
    """Words of the benchmark, quoted, through a file of one word a line."""
    path = work_path(spark, "stop-words")
    words = t.table(spark, folder, "benchmark").select(F.explode(X.words("text")).alias("word"))
    words.select(F.concat(F.lit('"'), "word", F.lit('"'))).write.text(path)
    return lists.read_stop_words(spark, path)


@query
def vector_file(spark, folder):
    """Embeddings through a file of word vectors, with a count line that isn't one."""
    path = work_path(spark, "vectors")
    rows = t.table(spark, folder, "embeddings")
    parts = F.transform("embedding", lambda v: v.cast("string"))
    lines = rows.select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(parts, " ")).alias("v"))
    count = rows.agg(F.concat(F.count("*").cast("string"), F.lit(" 64")).alias("v"))
    lines.unionByName(count).write.text(path)
    millionths = F.transform("vec", lambda v: F.round(v.cast("double") * 1000000).cast("bigint"))
    return lists.read_word_vectors(spark, path, t.VECTOR_SIZE).select("word", _joined(millionths).alias("vec"))


@query
def id_log(spark, folder):
    """Ids linked on pages, appended to a log in two parts, read back, and what the log lacks."""
    path = work_path(spark, "ids")
    linked = stored(pages.link_ids(t.table(spark, folder, "pages")), "linked")
    for part in (0, 1):
        lists.append_ids(linked.filter(F.col("page_id") % 3 == part), path)
    return ids.unseen_ids(linked, lists.read_ids(spark, path))


@query
def id_log_bucketed(spark, folder):
    """The same through a growing log in buckets: what two of three parts added, and what of all ids is new then."""
    linked = stored(pages.link_ids(t.table(spark, folder, "pages")), "linked")
    log = IdLog(spark, work_path(spark, "idlog").rsplit("/", 1)[1].replace("-", "_"))
    for part in (0, 1):
        log.add_unseen(linked.filter(F.col("page_id") % 3 == part), lambda rows: stored(rows, "fresh"))
    added = log.table().withColumn("is_new", F.lit(False))
    return added.unionByName(log.unseen(linked).withColumn("is_new", F.lit(True)))


@query
def first_ids(spark, folder):
    """The first hundred ids by name: that limit is the operator's feature."""
    return ids.first_ids(pages.link_ids(t.table(spark, folder, "pages")), 100)


@query
def json_sink(spark, folder):
    """Captured comments written as JSON records with plain time text."""
    path = work_path(spark, "json")
    capture.write_comments(t.comments(spark, folder), path)
    return spark.read.schema(capture.CAPTURED).json(path)


@query
def json_source(spark, folder):
    """Written comments read back through the batch source."""
    path = work_path(spark, "json")
    capture.write_comments(t.comments(spark, folder), path)
    return capture.read_comments(spark, path).select("timestamp", "user", "comment")


@query
def fitted_tables(spark, folder):
    """A vocabulary saved as a table and loaded."""
    path = work_path(spark, "vocabulary")
    artifacts.save_table(fit_vocabulary(t.table(spark, folder, "benchmark"), "item_id", "text"), path)
    return artifacts.load_table(spark, path)


def _pages_with_posts(spark, folder):
    """Pages with two links to posts and comments each, made of the page's number."""
    number = F.col("page_id").cast("string")
    link = F.concat(
        F.lit('<a href="/story.php?sid='), number, F.lit('&x=1">s</a><a href="https://h.example/c?ctoken='),
        number, F.lit("_"), (F.col("page_id") * 7).cast("string"), F.lit('&y">c</a>'),
    )
    return t.spread(t.table(spark, folder, "pages"), "page_id").withColumn("html", F.concat("html", link))


@query
def post_ids(spark, folder):
    return pages.post_ids(_pages_with_posts(spark, folder))


@query
def comment_links(spark, folder):
    return pages.comment_links(_pages_with_posts(spark, folder))
