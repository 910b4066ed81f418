"""Names that configurations may use."""

from kartograf.functions.arrays import ANTENNA_AGGREGATIONS, METRICS
from kartograf.operators import networks, reduction, series, snapshots
from kartograf.operators.pairs import Dissimilarity

SMOOTHING = {
    "kernel_moving_average": series.kernel_moving_average,
    "temporal_moving_average": series.temporal_moving_average,
}

AUGMENTATIONS = {
    "IQToAbs": snapshots.iq_to_abs,
    "TimeToFrequency": snapshots.time_to_frequency,
    "RandomMaskFixedK": snapshots.drop_antennas_to,
}


def _general(antennas: int, metric: str = "cosine", single_antenna: bool = True, antenna_aggregation: str = "sum",
             **params) -> Dissimilarity:
    if metric not in METRICS or antenna_aggregation not in ANTENNA_AGGREGATIONS:
        raise KeyError(f"unknown metric {metric!r} or aggregation {antenna_aggregation!r}")
    if not single_antenna:
        return Dissimilarity(metric, 1, "sum", params)
    return Dissimilarity(metric, antennas, antenna_aggregation, params)


CC_METRICS = {
    "CIRA": lambda antennas, **p: _general(antennas, metric="cityblock", **p),
    "cosine": lambda antennas, **p: _general(antennas, metric="cosine", **p),
    "general": _general,
    # on signature scalars: one value per antenna, compared by absolute difference
    "signature": lambda antennas, antenna_aggregation="sum": Dissimilarity("cityblock", antennas, antenna_aggregation),
}

REDUCTIONS = {
    "PCA": reduction.PrincipalComponents,
    "Isomap": reduction.isomap,
    "t-SNE": reduction.tsne,
    "UMAP": reduction.umap,
}
NON_PARAMETRIC = ("t-SNE", "Isomap", "UMAP")

MODELS = {
    "FingerprintingModel": "fingerprint",
    "SiameseChannelChartingModel": "siamese",
    "TripletChannelChartingModel": "triplet",
    "AutoencoderModel": "autoencoder",
    "GDMModel": "paths",
}
BACKBONES = {"MLP": networks.MLP}
CRITERIONS = ("MSE", "HuberLoss", "TripletMarginLoss")
LR_SCHEDULERS = networks.SCHEDULES
DATASETS = ("FingerprintingDataset", "SiameseCCDataset", "TimeTripletCCDataset", "GDMDataset")
