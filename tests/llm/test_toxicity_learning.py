"""Every labelled note takes part in learning and in the thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkledger.llm import toxicity


def test_all_notes_count(spark, monkeypatch):
    """A word that only toxic notes behind the first 1,500 hold is learned, in one part and in several."""
    table = spark.range(6000).select(F.col("id").alias("position"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    late = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("position"), "position")) > 1500
    said = F.when(F.col("toxic") == 0, "fine work").when(late, "you vermin").otherwise("you idiot")
    table = table.select("position", "toxic", F.concat(F.lit("page "), "position", F.lit(" "), said).alias("notes"))
    assert table.filter("notes like '%vermin%'").count() == 500
    for part in (toxicity.PART_NOTES, 1200):
        monkeypatch.setattr(toxicity, "PART_NOTES", part)
        model = toxicity.fit_toxicity(table, table.select("position", "toxic"))
        vermin, idiot, fine = toxicity.score_texts(model, ["page 7 vermin", "page 7 idiot", "page 7 fine work"])
        assert min(vermin, idiot) >= max(0.7, model.thresholds[None]) and fine < 0.3


def test_cuts_are_the_best_of_all_scores(spark):
    draw = np.random.default_rng(6)
    rows = []
    for lang in ("en", "de", "few"):
        for _ in range(12 if lang == "few" else 700):
            toxic = int(draw.random() < (0.3 if lang != "few" else 0.1))
            rows.append((lang, toxic, float(np.clip(draw.normal(0.3 + 0.4 * toxic, 0.2), 0, 1))))
    table = spark.createDataFrame(rows, "language string, toxic int, score double").repartition(5)
    got = {r["language"]: r["cut"] for r in toxicity._best_cuts(table, ["language"]).collect()}
    assert set(got) == {"en", "de"}

    def f1(own, c):
        taken = [t for t, s in own if s >= c]
        return 2 * sum(taken) / max(1, len(taken) + sum(t for t, _ in own))

    for lang, cut in got.items():
        own = [(t, s) for x, t, s in rows if x == lang]
        assert abs(f1(own, cut) - max(f1(own, s) for _, s in own)) < 0.005
    assert toxicity._best_cuts(table.withColumn("one", F.lit(1)), ["one"]).count() == 1
