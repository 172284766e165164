"""Evaluation of detections: greedy one-to-one matching, and interpolated average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..sources import kept
from .running import running_sums

POINTS = 100


def match(truth: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """``found_id, truth_id`` of matched boxes.

    truth: ``image, kind, truth_id, box``; found: ``image, kind, found_id, box, score``;
    ids tell boxes apart.  By falling score (ties: smaller id) each found box takes the
    free true box of its image and kind that it overlaps most (ties: smaller id), by
    ``least`` or more.  As all true boxes prefer the higher score, this is the one stable
    matching: found boxes ask for their best, true ones keep the best that asks, and
    those turned away ask for the next, all groups at once, so no group is one task's.
    """
    t = truth.select("image", "kind", "truth_id", F.col("box").alias("true_box"))
    pairs = found.join(t, ["image", "kind"]).select("found_id", "truth_id", "score", iou(F.col("box"), F.col("true_box")).alias("overlap"))
    pairs = kept(pairs.where(F.col("overlap") >= least), "overlaps")
    while True:
        asks = pairs.groupBy("found_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "truth_id", "score")).alias("b")).select("found_id", "b.truth_id", "b.score")
        holds = asks.groupBy("truth_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "found_id")).alias("b")).select("truth_id", F.col("b.found_id").alias("holder"))
        answered = kept(asks.join(holds, "truth_id").select("found_id", "truth_id", (F.col("found_id") == F.col("holder")).alias("held")), "asks")
        refused = answered.where("NOT held").select("found_id", "truth_id")
        if not refused.take(1):
            return answered.select("found_id", "truth_id")
        pairs = kept(pairs.join(refused, ["found_id", "truth_id"], "left_anti"), "overlaps")


def average_precision(truth: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """``kind, n_truth, n_found, n_matched, ap`` of every kind of true box.

    ``ap`` is the mean, over the recalls 0, 1/100 to 1, of the best precision at that
    recall or a higher one, 0 where none is reached.  Boxes that are null overlap nothing.
    """
    hits = match(truth, found, least).select("found_id", F.lit(1).alias("hit"))
    ranked = running_sums(found.join(hits, "found_id", "left").select("kind", "found_id", "score", F.coalesce("hit", F.lit(0)).alias("hit")), ["kind"], [F.desc("score"), F.asc("found_id")], {"hits": F.col("hit")})
    counts = truth.groupBy("kind").agg(F.count(F.lit(1)).alias("n_truth"))
    per_recall = ranked.join(counts, "kind").groupBy("kind", F.floor(F.col("hits") * POINTS / F.col("n_truth")).cast("int").alias("upto")).agg(F.max(F.col("hits") / F.col("place")).alias("precision"))
    # A row for each kind and recall at most: each is the best for the recalls up to its own.
    points = per_recall.withColumn("at", F.explode(F.sequence(F.lit(0), "upto"))).groupBy("kind", "at").agg(F.max("precision").alias("best"))
    score = points.groupBy("kind").agg((F.sum("best") / (POINTS + 1)).alias("ap"))
    totals = ranked.groupBy("kind").agg(F.count(F.lit(1)).alias("n_found"), F.sum("hit").alias("n_matched"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(totals, "kind", "left").join(score, "kind", "left").select("kind", "n_truth", zero("n_found"), zero("n_matched"), F.coalesce("ap", F.lit(0.0)).alias("ap"))
