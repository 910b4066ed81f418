"""Whole jobs against array code on small fixtures, and the files they leave."""

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kartograf.operators.pairs import Dissimilarity
from kartograf.plans import jobs, registry
from kartograf.sources import results, schema, takes

RNG = np.random.default_rng(2)
N, A, T = 24, 3, 5
CIR = RNG.normal(size=(N, 2, A, T))
MASK = RNG.random((N, A)) > 0.2
TS = np.cumsum(RNG.random(N) * 0.1)
TS[12:] += 5
TOA = np.where(MASK, RNG.random((N, A)), np.nan)
REF = RNG.normal(size=(N, 2))


def snapshot_rows(spark, ids=range(N)):
    data = [(i, 1, float(TS[i]), REF[i].tolist(), [0.2, 0.3], CIR[i].tolist(), [bool(v) for v in MASK[i]],
             [None if np.isnan(v) else float(v) for v in TOA[i]]) for i in ids]
    return spark.createDataFrame(data, schema.SNAPSHOT)


def smoothed(k, honor):
    """Masked means of magnitude and of unit phase vectors inside the two stretches without a gap."""
    z = CIR[:, 0] + 1j * CIR[:, 1]
    out = np.full(z.shape, np.nan + 0j)
    for part in (range(12), range(12, N)):
        for i in part:
            w = [j for j in range(i - (k - 1) // 2, i + k // 2 + 1) if j in part]
            for a in range(A):
                good = [j for j in w if MASK[j, a] or not honor]
                if good:
                    m = np.abs(z[good, a]).mean(axis=0)
                    out[i, a] = m * np.exp(1j * np.angle(np.exp(1j * np.angle(z[good, a])).mean(axis=0)))
    return out


def filtered(k):
    out = np.empty((N, A))
    for part in (slice(0, 12), slice(12, N)):
        for a in range(A):
            x = TOA[part, a]
            good = np.flatnonzero(~np.isnan(x))
            x = np.interp(np.arange(12), good, x[good])
            at = lambda p: x[(lambda r: r if r < 12 else 23 - r)(p % 24)]
            out[part, a] = [np.mean([at(i - (k - 1) // 2 + o) for o in range(k)]) for i in range(12)]
    return out


def test_preparation_for_distances_matches_array_code(spark):
    z = smoothed(4, True)
    with np.errstate(invalid="ignore"):
        z = z / np.sqrt((np.abs(z) ** 2).sum(axis=2, keepdims=True))
    turn = np.exp(-2j * np.pi * np.fft.fftfreq(T)[None, None] * (filtered(3) / 0.25)[:, :, None])
    want = np.fft.ifft(np.fft.fft(z) * turn)[::3]
    long = jobs.prepare(snapshot_rows(spark), "kernel_moving_average", {"kernel_size_mag": 4, "max_time_diff": 0.5}, "unit", "self",
                        {"kernel_size": 3, "max_time_diff": 0.5}, True, 0.25, reduction=3, for_distances=True)
    got = long.orderBy("id", "antenna").collect()
    assert len(got) == len(want) * A
    for r in got:
        line = want[r["id"] // 3, r["antenna"]]
        if np.isnan(line).any():
            assert r["re"] is None or None in r["re"]
        else:
            np.testing.assert_allclose(np.array(r["re"]) + 1j * np.array(r["im"]), line, atol=1e-9)


def test_dissimilarity_job_writes_the_distance_file(spark, tmp_path):
    config = {"metric": {"metric_name": "CIRA", "metric_params": {"antenna_aggregation": "mean"}},
              "dataset_config": {"reduction_factor": 2, "smoothing_type": "kernel_moving_average",
                                 "smoothing_params": {"kernel_size_mag": 4, "max_time_diff": 0.5}, "norm": "unit"}}
    out = jobs.dissimilarity_job(snapshot_rows(spark), config, str(tmp_path / "cc"))
    z = smoothed(4, True)
    m = np.abs(z) / np.sqrt((np.abs(z) ** 2).sum(axis=2, keepdims=True))
    m = m[::2].reshape(12, -1)
    d = Dissimilarity("cityblock", A, "mean").between(m, m)
    pairs = takes.read_distances(spark, str(tmp_path / "cc")).toPandas()
    assert len(pairs) == 66
    np.testing.assert_allclose(pairs["d"], np.nan_to_num(d, nan=1e10)[pairs["i"] // 2, pairs["j"] // 2], atol=1e-9)
    assert out["audit"].first()["pairs"] == 66 and out["histogram"].agg(F.sum("n")).first()[0] == 66 and out["bands"].count() == 199
    rows, _ = takes.read_split(spark, str(tmp_path / "cc"))
    assert rows.count() == 12
    with pytest.raises(AnalysisException):
        takes.write_distances(rows, rows, str(tmp_path / "cc"), {})
    config["metric"].update(geodesic=True, geodesic_neighbors=4)
    config["eval_only"] = True
    judged = jobs.dissimilarity_job(snapshot_rows(spark), config)
    assert judged["components"].first()[0] >= 1 and judged["bands"].count() == judged["measured_bands"].count() == 199
    reached = judged["geodesic_histogram"].agg(F.sum("n")).first()[0]
    assert judged["histogram"].agg(F.sum("n")).first()[0] == 66 == reached + judged["unreachable"].first()[0]


def test_takes_are_appended_in_list_order(spark, tmp_path):
    for number, ids in ((1, range(0, 6)), (2, range(6, 10))):
        raw = snapshot_rows(spark, ids).select("id", F.col("cir").alias("CIR"), F.col("valid_mask").alias("antenna_mask"), F.col("ts").alias("timestamp"),
                                               "reference", "toa", F.col("interp_diff").alias("interpolation_diff"))
        raw.write.parquet(str(tmp_path / f"take{number}" / "deep" / "data"))
        (tmp_path / f"take{number}" / "description.json").write_text(json.dumps({"additional_info": {"cir_res": 8e-9, "ru_ids": [4, 7]}}))
    read = lambda t: takes.read_take(spark, str(tmp_path), t)
    merged = takes.merge_takes([read(2), read(1), read(2)]).orderBy("id").collect()
    assert [r["id"] for r in merged] == list(range(14))
    assert [r["ts"] for r in merged] == [float(v) for v in (*TS[6:10], *TS[:6], *TS[6:10])]
    assert all((v is None) == (not ok) for r in merged for v, ok in zip(r["toa"], r["valid_mask"]))
    small = takes.merge_takes([read(1)], optimized=True)
    assert dict(small.dtypes)["cir"] == "array<array<array<float>>>" and dict(small.dtypes)["ts"] == "double"
    info = takes.read_description(spark, str(tmp_path), 1)
    takes.write_split(small, str(tmp_path / "split"), info)
    assert takes.read_split(spark, str(tmp_path / "split"))[1] == {"cir_res": 8e-9, "ru_ids": [4, 7]}
    with pytest.raises(AnalysisException):
        read(9)


def test_remembered_results_and_seeds(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert results.remembered(spark, str(tmp_path / "cache"), {"b": 1, "a": [2]}, make).count() == 3
    assert len(calls) == 1 and results.cache_key({"a": 1, "b": 2}) == results.cache_key({"b": 2, "a": 1})
    assert results.remember_seed(spark, 7, str(tmp_path)) == 7
    drawn = results.remember_seed(spark, None, str(tmp_path))
    assert spark.read.text(str(tmp_path / "seed")).first()[0] == str(drawn) and 0 <= drawn <= 65535


def test_training_and_reduction_jobs_score_and_save(spark, tmp_path):
    long = jobs.prepare(snapshot_rows(spark), norm="unit", filter_rus=[0, 2])
    steps = [{"augmentation_name": "IQToAbs", "augmentation_params": {"keep_iq": True}},
             {"augmentation_name": "RandomMaskFixedK", "augmentation_params": {"k": 1}}]
    items = jobs.training_items(long, steps, T).persist()
    first = items.orderBy("id").first()
    assert np.array(first["inputs"]).shape == (3, 2, T) and sum(first["valid_mask"]) >= 1
    charts = jobs.reduction_job(items, {"train": items}, {"dimensionality_reduction_type": "PCA", "fit_reduction": 2})
    scored = jobs.score(jobs.with_reference(charts["train"], items))
    row = scored["metrics"].first().asDict()
    assert set(row) == {"CE50", "CE75", "CE90", "CE95", "CE99", "MAE", "trustworthiness", "continuity", "kruskal_stress"}
    assert row["CE50"] <= row["CE99"]
    jobs.write_scores(scored, str(tmp_path / "out"))
    saved = json.loads(spark.read.text(str(tmp_path / "out" / "metrics")).first()[0])
    assert saved["MAE"] == pytest.approx(row["MAE"])
    config = {"model_config": {"model_type": "FingerprintingModel", "model_params": {"backbone_params": {"layer": [8], "norm": False}}},
              "trainer_config": {"max_epochs": 2}}
    trained = jobs.training_job(jobs.training_rows(items, "FingerprintingDataset"), config, 30)
    plain = jobs.score(jobs.with_reference(trained.predict(jobs.flat_inputs(items)), items), charted=False)
    assert set(plain["metrics"].columns) == {"CE50", "CE75", "CE90", "CE95", "CE99", "MAE"}
    motion = jobs.motion_rows(items, 2)
    assert motion.count() == N - 4


def test_registry_and_matrix():
    assert registry.CC_METRICS["CIRA"](4, antenna_aggregation="mean") == Dissimilarity("cityblock", 4, "mean")
    assert registry.CC_METRICS["cosine"](4, single_antenna=False).antennas == 1
    with pytest.raises(KeyError):
        registry.CC_METRICS["general"](4, metric="nothing")
    assert len(jobs.experiment_matrix()) == 360
