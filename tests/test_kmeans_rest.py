"""K-means runs until its centres rest."""

import random

import numpy as np
from pyspark.ml.linalg import Vectors

from postlens.operators.models import kmeans_fit


def test_another_step_moves_no_centre(spark):
    rng = random.Random(5)
    points = np.array([[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(4000)])
    frame = spark.createDataFrame([(Vectors.dense(x),) for x in points], ["features"]).coalesce(1)
    model = kmeans_fit(frame, 25, restarts=1)
    centres = np.array(model.clusterCenters())
    nearest = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    for k, c in enumerate(centres):
        assert np.abs(points[nearest == k].mean(axis=0) - c).max() < 0.001
    assert 20 < model.summary.numIter < 300
