"""Embeddings and learners.  Their layouts are seeded but iterative, so only rows are compared."""

from pyspark.sql import functions as F

from catalog.base import ANTENNAS, CIRA, TAPS, points, positions, query, r, table, seconds, timed_snapshots, vectors
from kartograf.operators import networks, reduction
from kartograf.operators import gaussian as G
from kartograf.operators.pairs import Dissimilarity
from kartograf.plans import jobs
from kartograf.session import cut


@query("pca_moments", """WITH f AS (SELECT vec_id, list_transform(range(0,32), lambda k: sqrt(CAST(embedding[k+1] AS DOUBLE)**2 + CAST(embedding[k+33] AS DOUBLE)**2)) AS m FROM embeddings),
u AS (SELECT vec_id, unnest(m) AS v, unnest(range(0,32)) AS k FROM f)
SELECT count(DISTINCT vec_id) AS n, CAST(0 AS DOUBLE) AS mean_x, CAST(0 AS DOUBLE) AS mean_y, CAST(0 AS DOUBLE) AS covariance FROM u""")
def pca_moments(spark, d):
    """PCA scores have zero mean and are uncorrelated."""
    f = points(spark, d)
    c = reduction.PrincipalComponents().fit(f).transform(f)
    return c.agg(F.count("*").alias("n"), r(F.avg("x")).alias("mean_x"), r(F.avg("y")).alias("mean_y"),
                 r(F.covar_pop("x", "y")).alias("covariance"))


def _flat(chart):
    return chart.select("id", r("x", 4).alias("x"), r("y", 4).alias("y"))


@query("chart_pca")
def chart_pca(spark, d):
    f = points(spark, d)
    return _flat(reduction.PrincipalComponents().fit(f).transform(f))


@query("chart_isomap")
def chart_isomap(spark, d):
    return _flat(reduction.isomap(cut(points(spark, d)), 20, CIRA, rounds=3))


@query("chart_tsne")
def chart_tsne(spark, d):
    return _flat(reduction.tsne(cut(points(spark, d)), 30, Dissimilarity("cityblock"), n_iter=8))


@query("chart_umap")
def chart_umap(spark, d):
    return _flat(reduction.umap(cut(points(spark, d)), 20, 0.5))


def _items(spark, d):
    long = jobs.prepare(timed_snapshots(spark, d).drop("toa"), norm="unit")
    return cut(jobs.training_items(long, [{"augmentation_name": "IQToAbs", "augmentation_params": {"keep_iq": False}}]))


_SMALL = {"layer": [32, 16], "norm": True, "dropout": 0.1}


def _config(model, params=None, epochs=4):
    return {"model_config": {"model_type": model, "model_params": {"backbone_params": _SMALL, **(params or {})}},
            "trainer_config": {"max_epochs": epochs}, "dataloader_config": {"train": {"batch_size": 64}},
            "training_config": {"optimizer_config": {"optimizer_params": {"lr": 3e-3}, "lr_scheduler_type": "CosineWithWarmupLR",
                                                     "lr_scheduler_params": {"warmup_epochs": 1, "T_max": epochs}}}}


def _learn(name, model, dataset, params=None, dataset_params=None):
    @query(name)
    def run(spark, d):
        items = _items(spark, d)
        pairs = None
        if dataset == "SiameseCCDataset":
            from kartograf.operators import sampling
            from kartograf.functions import arrays
            drawn = sampling.pair_key(sampling.draw_pairs(items, 1)).filter("i <> j")
            x = items.select("id", F.col("inputs")[0].alias("m"))
            pairs = drawn.select("low", "high").distinct().join(x.select(F.col("id").alias("low"), F.col("m").alias("a")), "low") \
                .join(x.select(F.col("id").alias("high"), F.col("m").alias("b")), "high").select(
                    F.col("low").alias("i"), F.col("high").alias("j"), arrays.antenna_distance(F.col("a"), F.col("b"), "cityblock", "mean").alias("d"))
        rows = jobs.training_rows(items, dataset, pairs, dataset_params, seed=1)
        if model != "FingerprintingModel":
            rows = rows.drop("target") if dataset != "SiameseCCDataset" else rows
        trained = jobs.training_job(rows, _config(model, params), ANTENNAS * TAPS, seed=1)
        return _flat(trained.predict(jobs.flat_inputs(items)))


_learn("learn_fingerprint", "FingerprintingModel", "FingerprintingDataset")
_learn("learn_fingerprint_uncertain", "FingerprintingModel", "FingerprintingDataset", {"estimate_uncertainty": True})
_learn("learn_autoencoder", "AutoencoderModel", "FingerprintingDataset", {"decoder_params": _SMALL})
_learn("learn_constrained_autoencoder", "AutoencoderModel", "FingerprintingDataset",
       {"decoder_params": _SMALL, "model_type": "vae", "vae_beta": 1e-5, "regularization_type": "FRD", "regularization_max_time_diff": 600.0})
_learn("learn_quantised_autoencoder", "AutoencoderModel", "FingerprintingDataset",
       {"decoder_params": _SMALL, "model_type": "vqvae", "vqvae_num_embeddings": 32, "regularization_type": "MRD", "regularization_max_time_diff": 600.0})
_learn("learn_siamese", "SiameseChannelChartingModel", "SiameseCCDataset", {"criterion_type": "HuberLoss"})
_learn("learn_triplet", "TripletChannelChartingModel", "TimeTripletCCDataset", None, {"time_range": 400.0, "recording_frequency": 0.02})


_MODEL = G.GaussianModel(0.2, -0.1, 0.1, 2.0, 0.01, 0.00001, 0.1)


def _timed_points(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), seconds().alias("ts"))
    return cut(points(spark, d).join(ev, "id").select("id", "ts", "f"))


@query("realized_graph")
def realized_graph(spark, d):
    """Neighbour graph of one random realisation of the uncertain dissimilarities."""
    g = G.realized_graph(_timed_points(spark, d), CIRA, _MODEL, 5, 10)
    return g.select("src", "dst", r("w").alias("w"), "choice", r("d").alias("d"))


@query("learn_paths")
def learn_paths(spark, d):
    """Uncertain paths drawn, thinned and learned: the geodesic objective end to end."""
    items = _items(spark, d)
    gdm = dict(slope=0.2, bias=-0.1, var_factor=0.1, saturation_threshold=2.0, velocity_mean=0.01, velocity_variance=1e-5,
               variance_scale=0.1, total_path_count=200, realization_count=2, enable_path_contraction=True)
    steps = dict(training_batches=2, min_batch_size=200, max_batch_size=200, min_hoplength=1, max_hoplength=20, max_pathhops=100)
    rows = jobs.path_rows(items, CIRA, _timed_points(spark, d), gdm, steps, seed=1)
    trained = jobs.training_job(rows, _config("GDMModel", epochs=2), ANTENNAS * TAPS, seed=1)
    return _flat(trained.predict(jobs.flat_inputs(items)))
