"""The jobs: snapshots to features, features to dissimilarities, charts, positions and scores.

Configurations are plain dicts with the names of the registry, as the experiment files use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.functions import arrays
from kartograf.operators import evaluation, gaussian, graph, multilateration, networks, sampling, series, snapshots
from kartograf.operators.ordering import stride, with_position
from kartograf.operators.pairs import Dissimilarity, condensed_distances, distance_audit, features, nearest_neighbors
from kartograf.plans import registry
from kartograf.session import cut
from kartograf.sources import results, takes


def _shape(df: DataFrame) -> tuple[int, int, int]:
    return tuple(df.select(*snapshots.shape(F.col("cir"))).first())


def prepare(df: DataFrame, smoothing_type: str | None = None, smoothing_params: dict | None = None,
            norm: str | None = None, norm_range: str = "self", tdoa_correction: dict | None = None,
            align_tdoa: bool = False, tap_seconds: float | None = None, filter_rus: list | None = None,
            reduction: int = 1, for_distances: bool = False) -> DataFrame:
    """Smooth, normalise, filter arrival times and align: antenna-long rows in snapshot order.

    The steps are the same for training and for distances, but not what surrounds them: training
    strides first, takes every antenna as valid and ends with zeros for what is missing; distances
    honour the mask, keep missing signals missing, and stride last.
    """
    taps = _shape(df)[2]
    if not for_distances:
        df = snapshots.relative_time(stride(df, reduction, "id"))
    long = snapshots.antenna_long(df)
    if filter_rus is not None:
        long = snapshots.keep_antennas(long, filter_rus)
    if not for_distances:
        long = long.withColumn("valid", F.lit(True))
    if smoothing_type is not None:
        long = registry.SMOOTHING[smoothing_type](long, taps, honor_mask=for_distances, **(smoothing_params or {}))
        long = long.drop("seg", "pos")
    if norm is not None:
        long = snapshots.normalize(long, norm, norm_range)
    if tdoa_correction is not None:
        long = series.tdoa_filter(long, **tdoa_correction).drop("seg", "pos")
    if align_tdoa:
        long = snapshots.align_to_toa(long, tap_seconds, taps)
    if for_distances:
        wanted = stride(df.select("id"), reduction, "id")
        return long.join(wanted, "id", "left_semi")
    blank = F.array_repeat(F.lit(0.0), taps)
    for c in ("re", "im"):
        filled = F.coalesce(F.col(c), blank)
        long = long.withColumn(c, F.transform(filled, lambda v: arrays.replace_missing(v)))
    return long


def training_items(long: DataFrame, augmentations: list[dict] | None = None, taps: int | None = None,
                   seed: int = 0) -> DataFrame:
    """Items with ``inputs``, ``valid_mask``, ``targets`` and ``timestamps``; augmentations in list order."""
    wide = snapshots.snapshots_wide(long)
    item = wide.select("id", F.col("cir").alias("inputs"), "valid_mask",
                       snapshots.optional(wide, "reference", "array<double>").alias("targets"),
                       F.col("ts").alias("timestamps"))
    for step in augmentations or []:
        name, params = step["augmentation_name"], dict(step.get("augmentation_params") or {})
        if name == "TimeToFrequency":
            params.setdefault("taps", taps)
        if name == "RandomMaskFixedK":
            params.setdefault("seed", seed)
        item = registry.AUGMENTATIONS[name](item, **params)
    return item


def flat_inputs(item: DataFrame, column: str = "inputs", mask: str | None = "valid_mask") -> DataFrame:
    """Network inputs ``x``: channels, antennas and taps in one array, invalid antennas zero."""
    x = F.col(column)
    if mask is not None and mask in item.columns:
        x = F.transform(x, lambda channel: F.zip_with(channel, F.col(mask), snapshots.zero_invalid))
    return item.withColumn("x", F.flatten(F.flatten(x)))


def metric_features(long: DataFrame, metric_name: str, antennas: int, taps: int) -> DataFrame:
    """(``id``, ``f``) for a channel-charting metric: tap magnitudes, or one signature per antenna."""
    if metric_name == "signature":
        value, width = F.array(arrays.signature(F.col("re"), F.col("im"), taps)), 1
    else:
        value, width = arrays.magnitude(F.col("re"), F.col("im")), taps
    broken = F.exists(value, lambda v: v.isNull())
    lined = long.select("id", "antenna", F.when(F.coalesce(broken, F.lit(True)), F.lit(None)).otherwise(value).alias("v"))
    wide = lined.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("antenna", "v"))).alias("a"))
    wide = wide.select("id", F.transform("a", lambda a: a["v"]).alias("vec"))
    return features(wide, "vec", "id", antennas, width)


def dissimilarity_job(df: DataFrame, config: dict, output: str | None = None) -> dict[str, DataFrame]:
    """Pairwise dissimilarities (and geodesics) of a split, with the diagnostics against the reference.

    Returns the plot tables; writes the distance file where ``output`` is given and ``eval_only``
    is not set.  Bands and histograms of measured dissimilarities are folded over all pairs, which are
    not listed; with ``band_fraction`` below 1 the bands are of a sample.  Geodesic jobs also give bands
    and histogram of the geodesics, read from that file (with ``eval_only``, from a table made for
    them), and the number of pairs that no path connects (``unreachable``), which the file holds at
    infinity and the plots leave out.
    """
    _, antennas, taps = _shape(df)
    options = dict(config.get("dataset_config", {}))
    step = options.pop("reduction_factor", 1)
    tap_seconds = options.pop("sampling_frequency", 8.138020833333334e-09)
    long = prepare(df, reduction=step, tap_seconds=tap_seconds, for_distances=True, **options)
    name = config["metric"]["metric_name"]
    metric = registry.CC_METRICS[name](antennas, **config["metric"].get("metric_params", {}))
    points = cut(metric_features(long, name, antennas, taps))
    audit = distance_audit(points, metric)
    out = {"features": points, "audit": audit}
    edges = None
    if config["metric"].get("geodesic"):
        near = nearest_neighbors(points, config["metric"]["geodesic_neighbors"], metric)
        edges = cut(near.select("src", "dst", F.col("d").alias("w")))
        labels = graph.connected_components(points.select("id"), edges)
        out["components"] = labels.agg(F.countDistinct("component").alias("components"))
        out["edges"] = edges
    placed = at = None
    if "reference" in df.columns:
        at = df.select("id", F.col("reference").alias("p"))
        placed = points.join(at, "id")
        out["histogram"] = evaluation.pair_histogram_2d(placed, metric)

    def with_truth(pairs: DataFrame) -> DataFrame:
        fraction = config.get("band_fraction", 1.0)
        drawn = pairs if fraction >= 1 else sampling.sample_exact(pairs.withColumn("_k", F.xxhash64("i", "j")), fraction, "_k")
        both = drawn.join(at.select(F.col("id").alias("i"), F.col("p").alias("a")), "i").join(at.select(F.col("id").alias("j"), F.col("p").alias("b")), "j")
        return both.select("d", arrays.euclidean(F.col("a"), F.col("b")).alias("e"))

    write = output and not config.get("eval_only")
    measured = lambda: condensed_distances(points, metric).withColumn("d", F.coalesce("d", F.lit(1e10)))
    sampled = config.get("band_fraction", 1.0) < 1
    pairs = None
    if write or (config.get("eval_only") and (edges is not None or sampled)):
        # the geodesic file has all pairs, at infinity where no path leads
        pairs = graph.geodesics_from(edges, points.select("id"), keep_upper=True, unreached=True).select(
            F.col("src").alias("i"), F.col("dst").alias("j"), F.col("d").cast("float").cast("double").alias("d")) \
            if edges is not None else measured()
        if write:
            takes.write_distances(df.join(points.select("id"), "id", "left_semi"), pairs, output, config)
            pairs = takes.read_distances(df.sparkSession, output)
        else:
            pairs = cut(pairs)
    if at is not None and (output or config.get("eval_only")):
        folded = lambda: evaluation.pair_bands(placed, metric)
        if edges is not None:
            judged = with_truth(pairs.filter(F.col("d") < float("inf")))
            out["bands"] = evaluation.dissimilarity_bands(judged)
            out["geodesic_histogram"] = evaluation.histogram_2d(judged, "e", "d")
            out["measured_bands"] = folded()
        else:
            out["bands"] = evaluation.dissimilarity_bands(with_truth(pairs)) if sampled else folded()
    if edges is not None and pairs is not None:
        out["unreachable"] = pairs.filter(F.col("d") == float("inf")).agg(F.count("*").alias("pairs"))
    return out


def score(chart: DataFrame, charted: bool = True, step: int = 1) -> dict[str, DataFrame]:
    """Scores of predictions (``id``, ``px``, ``py``, ``gx``, ``gy``, ``valid``).

    Charts are first aligned to the reference by an affine map fitted on all rows.  Errors use the
    valid rows.  The neighbourhood scores use every ``step``-th valid row, by default all.
    """
    if charted:
        aligned = evaluation.align_affine(chart)
    else:
        aligned = chart.withColumn("ax", F.col("px")).withColumn("ay", F.col("py"))
    aligned = cut(evaluation.with_error(aligned))
    usable = aligned.filter("valid")
    metrics = evaluation.error_summary(aligned)
    out = {"predictions": aligned, "ecdf": evaluation.ecdf(usable, "error"),
           "hexbin": evaluation.hexbin_mean(usable, "gx", "gy", "error"),
           "trajectory": stride(aligned, step, "id").select("id", "ax", "ay", "gx", "gy")}
    if charted:
        thinned = cut(stride(usable, step, "id"))
        for part in (evaluation.trustworthiness(thinned), evaluation.continuity(thinned), evaluation.kruskal_stress(thinned)):
            metrics = metrics.withColumn(part.columns[0], part.scalar())
        out["colors"] = evaluation.chart_colors(stride(aligned, step, "id"))
    out["metrics"] = metrics
    return out


def write_scores(scores: dict[str, DataFrame], path: str) -> None:
    results.write_predictions(scores["predictions"], path)
    results.write_metrics(scores["metrics"], path)


def with_reference(chart: DataFrame, items: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Chart positions next to the reference, ready for ``score``."""
    joined = chart.withColumnsRenamed({"x": "px", "y": "py"}).join(
        items.select("id", F.col("targets")[0].alias("gx"), F.col("targets")[1].alias("gy")), "id")
    return joined.join(valid, "id") if valid is not None else joined.withColumn("valid", F.lit(True))


def reduction_job(train: DataFrame, tests: dict[str, DataFrame], config: dict, seed: int = 0) -> dict[str, DataFrame]:
    """Charts of each test set.  PCA is fitted on (strided) training rows; the others refit per set.

    Inputs are items; a non-parametric reducer uses every ``fit_reduction``-th row of the test set.
    """
    kind = config["dimensionality_reduction_type"]
    params = {k: v for k, v in config.get("dimensionality_reduction_params", {}).items() if k not in ("n_components", "metric")}
    metric = config.get("dimensionality_reduction_params", {}).get("metric")
    step = config.get("fit_reduction") or 1
    rows = lambda d: flat_inputs(d).select("id", F.col("x").alias("f"))
    if kind not in registry.NON_PARAMETRIC:
        # training rows come shuffled: a stride over the order of a hash
        shuffled = rows(train).withColumn("_mix", F.xxhash64("id", F.lit(seed)))
        fitted = registry.REDUCTIONS[kind]().fit(stride(shuffled, step, "_mix"))
        return {name: fitted.transform(rows(d)) for name, d in tests.items()}
    if metric:
        params["metric"] = Dissimilarity({"manhattan": "cityblock"}.get(metric, metric))
    if kind in ("UMAP", "t-SNE"):
        params["seed"] = seed
    return {name: registry.REDUCTIONS[kind](cut(stride(rows(d), step, "id")), **params) for name, d in tests.items()}


def training_rows(items: DataFrame, dataset_type: str, pairs: DataFrame | None = None, params: dict | None = None,
                  seed: int = 0) -> DataFrame:
    """Rows of a learner: inputs ``x`` with targets, drawn partners, or drawn triplets."""
    flat = flat_inputs(items)
    base = flat.select("id", "x", F.col("timestamps").alias("ts"), F.col("targets").alias("target"))
    if dataset_type == "FingerprintingDataset":
        return base
    other = lambda key, name: flat.select(F.col("id").alias(key), F.col("x").alias(name))
    if dataset_type == "SiameseCCDataset":
        drawn = sampling.look_up_distances(sampling.draw_pairs(items, seed), pairs)
        return drawn.join(other("i", "x"), "i").join(other("j", "x2"), "j").select(
            F.col("i").alias("id"), "x", "x2", F.col("d").alias("target"))
    if dataset_type == "TimeTripletCCDataset":
        drawn = sampling.draw_triplets(items, seed=seed, ts="timestamps", **(params or {}))
        return drawn.join(other("anchor", "x"), "anchor").join(other("positive", "x_positive"), "positive") \
            .join(other("negative", "x_negative"), "negative").select(
                F.col("anchor").alias("id"), "x", "x_positive", "x_negative")
    raise KeyError(dataset_type)


def path_rows(items: DataFrame, metric: Dissimilarity, points: DataFrame, gdm_params: dict, training_params: dict,
              seed: int = 0, neighbors: int = 20) -> DataFrame:
    """Training rows of the path objective: node inputs of each thinned path, its mean and variance.

    ``points`` has (``id``, ``ts``, ``f``) for the dissimilarity.
    """
    g, t = gdm_params, training_params
    model = gaussian.GaussianModel(g["slope"], g["bias"], g["var_factor"], g.get("saturation_threshold"),
                                   g["velocity_mean"], g["velocity_variance"], g.get("variance_scale", 0.1))
    asked = gaussian.path_requests(points, t["training_batches"], t["min_batch_size"], t["max_batch_size"],
                                   g["total_path_count"], g["realization_count"], seed)
    drawn = gaussian.draw_paths(points, metric, model, asked, g["realization_count"], neighbors,
                                g.get("enable_path_contraction", True), seed)
    thin = gaussian.training_paths(drawn, t["training_batches"], t["min_hoplength"], t["max_hoplength"],
                                   t["max_pathhops"], t.get("randomize_pathhops", False), seed)
    nodes = thin.select("path_id", "mean", "variance", F.posexplode("nodes").alias("at", "id"))
    inputs = flat_inputs(items).select("id", "x").hint("merge")
    rows = nodes.join(inputs, "id").groupBy("path_id").agg(
        F.first("mean").alias("mean"), F.first("variance").alias("variance"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("nodes")) \
        .withColumnRenamed("path_id", "id")
    return cut(rows)  # read more than once; paths are drawn once


def motion_rows(items: DataFrame, reduction: int = 10) -> DataFrame:
    """Triples of rows ``reduction`` apart with their two time steps, for the acceleration term."""
    rows = with_position(flat_inputs(items).select("id", "x", F.col("timestamps").alias("ts")), "id")
    one = rows.select("pos", "id", F.col("x").alias("a"), F.col("ts").alias("ta"))
    later = lambda k, x, t: rows.select((F.col("pos") - k * reduction).alias("pos"), F.col("x").alias(x), F.col("ts").alias(t))
    joined = one.join(later(1, "b", "tb"), "pos").join(later(2, "c", "tc"), "pos")
    steps = joined.filter((F.col("tb") - F.col("ta") > 1e-8) & (F.col("tc") - F.col("tb") > 1e-8))
    return steps.select("id", F.array("a", "b", "c").alias("motion"),
                        F.array(F.col("tb") - F.col("ta"), F.col("tc") - F.col("tb")).alias("dt"))


def build_model(config: dict, inputs: int) -> networks.Model:
    """A learner from its configuration."""
    kind = registry.MODELS[config["model_type"]]
    p = config.get("model_params", {})
    backbone = p.get("backbone_params", {})
    outputs = p.get("output_dim", 2)
    variant = p.get("model_type", "ae")
    options = {}
    if kind == "fingerprint":
        options["uncertainty"] = p.get("estimate_uncertainty", False)
    if kind == "autoencoder":
        options = {"variant": variant, "beta": p.get("vae_beta", 1.0), "codewords": p.get("vqvae_num_embeddings", 512),
                   "commitment_cost": p.get("vqvae_commitment_cost", 0.25),
                   "quantized": p.get("vqvae_return_quantized", True),
                   "regularization": p.get("regularization_type"),
                   "regularization_weight": p.get("regularization_weight", 1.0),
                   "max_time_diff": p.get("regularization_max_time_diff", 1.0)}
    if kind == "triplet":
        options["margin"] = p.get("criterion_params", {}).get("margin", 1.0)
    if kind == "paths":
        options = dict(p.get("criterion_params", {}))
    if "reg_criterion_type" in p:
        options["reg_criterion"] = p["reg_criterion_type"]
    width = outputs * (2 if options.get("uncertainty") or variant == "vae" else 1)
    shape = lambda q: {"layer": tuple(q.get("layer", (1024, 512, 256))), "norm": q.get("norm", True), "dropout": q.get("dropout", 0.0)}
    make = registry.BACKBONES[p.get("backbone_type", "MLP")]
    decoder = None
    if kind == "autoencoder":
        decoder = registry.BACKBONES[p.get("decoder_type", "MLP")](outputs, outputs=inputs, **shape(p.get("decoder_params", backbone)))
    criterion = p.get("criterion_type", "MSE")
    return networks.Model(kind, make(inputs, outputs=width, **shape(backbone)), decoder,
                          criterion if criterion in ("MSE", "HuberLoss") else "MSE", options)


def training_job(rows: DataFrame, config: dict, inputs: int, seed: int = 0, workers: int | None = None) -> networks.Trained:
    """Train a configured learner on its rows."""
    model = build_model(config["model_config"], inputs)
    optim = config.get("training_config", {}).get("optimizer_config", {})
    return networks.train(
        model, rows, config["trainer_config"]["max_epochs"],
        config.get("dataloader_config", {}).get("train", {}).get("batch_size", 1024),
        optim.get("optimizer_params", {}).get("lr", 1e-3), seed, workers,
        optim.get("lr_scheduler_type"), optim.get("lr_scheduler_params"),
        optim.get("optimizer_params", {}).get("weight_decay", 0.01))


def positions_job(df: DataFrame, height: float = 0.86, threshold: float = 6.0, receivers=multilateration.RECEIVERS,
                  speed: float = multilateration.SPEED_OF_LIGHT) -> dict[str, DataFrame]:
    """Positions from arrival times with their errors: rows (``id``, ``toa``, ``gx``, ``gy``)."""
    found = cut(multilateration.locate(df, receivers, speed, 2, height, threshold))
    errors = evaluation.with_error(found.join(df.select("id", "gx", "gy"), "id"), ("x", "y"))
    return {"positions": found, "success": multilateration.success_rate(found),
            "metrics": evaluation.error_summary(errors.filter("success"), valid=None)}


# Areas and methods of the study, in its order.  Fixed values.
AREAS = ("full", "corridor", "open")
METHODS = ("AE", "Constrained_AE", "FP", "PSSN", "Siamese_G", "Siamese", "Triplet", "UAGeo", "Isomap", "PCA", "t-SNE", "UMAP")


def experiment_matrix(areas=AREAS, methods=METHODS, runs: int = 10):
    """All (area, method, run) of the study, in order."""
    return [(a, m, r) for a in areas for m in methods for r in range(1, runs + 1)]
