"""Operators against plain versions: filters, clustering, chunked windows, sound files, streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow import helpers
from spliceflow.config import Cfar, Frames
from spliceflow.operators import changepoint as cp
from spliceflow.operators import cluster, filters, frames, normalize, reconstruct, segments, silence, spectral
from spliceflow.plans import pipelines

from . import plain


def stream(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "stream_id string, idx long, x double")


def by_idx(df, column):
    return [r[column] for r in df.orderBy("stream_id", "idx").collect()]


@pytest.mark.parametrize("curve", ["linear", "equal_power"])
def test_whole_crossfades(spark, curve):
    rng = random.Random(8)
    lengths = [rng.choice([1, 2, 3, 5, 9, 20, 40]) for _ in range(60)]
    ends = np.cumsum(lengths)
    x = np.arange(1, ends[-1] + 1) % 17 + 1.0
    segs = [("s", i, int(e - n), int(e), i % 2) for i, (n, e) in enumerate(zip(lengths, ends, strict=True))]
    got = reconstruct.crossfaded_whole(stream(spark, x), spark.createDataFrame(segs, "stream_id string, seg_id long, i0 long, i1 long, label int"), 12, curve).orderBy("label", "out_idx").collect()
    for label in (0, 1):
        out = np.empty(0)
        for _, _, a, b, own in segs:
            if own == label:
                f = min(12, len(out), b - a)
                t = np.arange(f) / max(f, 1)
                rise, fade = (t, 1 - t) if curve == "linear" else (np.sin(np.pi / 2 * t), np.cos(np.pi / 2 * t))
                cut = len(out) - f
                out = np.concatenate([out[:cut], out[cut:] * fade + x[a : a + f] * rise, x[a + f : b]])
        mine = [(r.out_idx, r.x) for r in got if r.label == label]
        assert [i for i, _ in mine] == list(range(len(out)))
        assert np.allclose([v for _, v in mine], out)


NOISE = np.random.default_rng(3).normal(size=500).round(3)


def gain(sos, hz, rate):
    z = np.exp(-2j * np.pi * hz / rate)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))


@pytest.mark.parametrize("order", [1, 2, 4, 5])
def test_butterworth_gains(order):
    low, high = (filters.butterworth(order, 700.0, 8000, k) for k in ("low", "high"))
    assert gain(low, 0, 8000) == pytest.approx(1) and gain(high, 4000, 8000) == pytest.approx(1)
    assert gain(low, 700, 8000) == pytest.approx(0.5**0.5) and gain(high, 700, 8000) == pytest.approx(0.5**0.5)
    for f in (100, 1500, 3000):
        w = np.tan(np.pi * f / 8000) / np.tan(np.pi * 700 / 8000)
        assert gain(low, f, 8000) == pytest.approx((1 + w ** (2 * order)) ** -0.5)
    band = filters.butterworth(order, (500.0, 900.0), 8000, "band")
    assert gain(band, 500, 8000) == pytest.approx(0.5**0.5) and gain(band, 900, 8000) == pytest.approx(0.5**0.5)
    with pytest.raises(ValueError, match="unknown filter"):
        filters.butterworth(2, 100, 8000, "notch")


def test_sections_sample_by_sample():
    sos = filters.butterworth(4, (300.0, 1500.0), 8000, "band")
    y, x = NOISE.copy(), NOISE
    for b0, b1, b2, _, a1, a2 in sos:
        x, y = y, np.empty(len(x))
        for n in range(len(x)):
            at = lambda v, d, n=n: v[n - d] if n >= d else 0.0
            y[n] = b0 * x[n] + b1 * at(x, 1) + b2 * at(x, 2) - a1 * at(y, 1) - a2 * at(y, 2)
    got, state = filters.run_sections(sos, NOISE[:77], np.zeros((len(sos), 2)))
    rest, _ = filters.run_sections(sos, NOISE[77:], state)
    assert np.allclose(np.concatenate((got, rest)), y)


def test_filtering_in_pieces(spark):
    sos = filters.butterworth(3, 900.0, 8000, "low")
    whole = filters.zero_phase(sos, NOISE)
    got = by_idx(filters.filtered(stream(spark, NOISE), sos, piece=200, settle=100), "x")
    assert np.allclose(got, whole, atol=1e-9)
    assert np.allclose(filters.zero_phase(sos, np.ones(200)), 1)
    assert filters.zero_phase(sos, np.ones(5)).tolist() == [1.0] * 5


def test_response_has_died_down_after_settling():
    for order, cutoff, kind in [(4, (80.0, 12000.0), "band"), (4, 1.0, "low"), (5, 3000.0, "low"), (4, 1.0, "high")]:
        sos = filters.butterworth(order, cutoff, 44100, kind)
        n = filters.settling(sos)
        x = np.random.default_rng(1).normal(size=3 * n + 2000)
        assert np.allclose(filters.zero_phase(sos, x)[n // 2 + n :], filters.zero_phase(sos, x[n // 2 :])[n:], rtol=0, atol=1e-9)


def test_windows_over_chunks_are_exact(spark):
    s = stream(spark, np.abs(NOISE))
    for method in ("CA", "OS", "SO"):
        add = {"t": cp.cfar_threshold("x", Cfar(method=method))}
        assert by_idx(helpers.near(s, 18, 18, add), "t") == by_idx(helpers.near(s, 18, 18, add, chunk=40), "t")
    with pytest.raises(ValueError, match="CFAR"):
        Cfar(method="XY")


def test_carried_values_over_chunks(spark):
    s = stream(spark, NOISE)
    value = F.when(F.col("x") > 1.5, F.col("x"))
    assert by_idx(helpers.last_before(s, value, "v", chunk=7), "v") == by_idx(helpers.last_before(s, value, "v"), "v")
    assert np.allclose(by_idx(helpers.running_sum(s, F.col("x"), "v", chunk=7), "v"), np.cumsum(NOISE))
    quiet = [r[1:] for r in sorted(silence.silent_regions(s, 0.8, 2).collect())]
    runs, start = [], None
    for i, v in enumerate([*(np.abs(NOISE) <= 0.8), False]):
        if v and start is None:
            start = i
        if not v and start is not None:
            runs += [(start, i)] * (i - start >= 2)
            start = None
    assert quiet == runs


@pytest.mark.parametrize("values", [NOISE, [1.0], [2.0] * 9, [1.0, 2.0], NOISE.round(0)])
def test_percentiles(spark, values):
    got = helpers.percentiles(stream(spark, values), "x", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.85, "e": 1.0}).first()
    assert np.allclose(got[1:], np.percentile(values, [0, 5, 50, 85, 100]))


def test_percentiles_of_heavy_tails(spark):
    """Log-normal values over hundreds of orders of size: what is looked at by value is a thousandth of the rows."""
    n = 400_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("stream_id"), F.exp(20 * F.randn(5)).alias("x"))
    held = helpers.cut(df)
    got = {r.stream_id: r[1:] for r in helpers.percentiles(held, "x", {"a": 0.001, "b": 0.05, "c": 0.5, "d": 0.95, "e": 0.9999}).collect()}
    table = held.toPandas()
    for s, x in table.groupby("stream_id")["x"]:
        assert np.allclose(got[s], np.percentile(x, [0.1, 5, 50, 95, 99.99]), rtol=1e-9, atol=0)
    # the same with a third of all values equal, and with infinite ones
    tied = held.withColumn("x", F.when(F.rand(1) < 0.33, 7.0).when(F.rand(2) < 0.01, float("inf")).otherwise(F.col("x")))
    tied = helpers.cut(tied)
    got = {r.stream_id: r[1:] for r in helpers.percentiles(tied, "x", {"a": 0.4, "b": 0.5, "c": 0.6, "d": 1.0}).collect()}
    for s, x in tied.toPandas().groupby("stream_id")["x"]:
        assert np.allclose(got[s][:3], np.percentile(x, [40, 50, 60]), rtol=1e-9, atol=0) and got[s][3] == np.inf


def test_constant_and_empty_streams(spark):
    constant = stream(spark, [0.5] * 20)
    assert set(by_idx(normalize.robust_minmax(constant, ["x"]), "x")) == {0.5}
    assert set(by_idx(normalize.minmax(constant, "x"), "x")) == {0.5}
    empty = stream(spark, [0.0]).limit(0)
    assert helpers.percentiles(empty, "x", {"p": 0.5}).count() == 0
    assert silence.silent_regions(empty, 1.0, 1).count() == 0
    assert frames.hopping(empty, 8, 4).count() == 0


def candidates(spark, places):
    return spark.createDataFrame([("s", i, float(i % 7)) for i in places], "stream_id string, idx long, score double")


def test_greedy_choices(spark):
    places = sorted(random.Random(2).sample(range(400), 120))
    assert by_idx(cp.earliest_first(candidates(spark, places), 9), "idx") == plain.earliest_first(places, 9, 0.0)
    assert by_idx(cp.strongest_first(candidates(spark, places), 9, "score"), "idx") == plain.strongest_first([(i, i % 7) for i in places], 9)


@pytest.mark.parametrize(("gap", "chunk"), [(9, 16), (9, 5), (3, 64), (40, 7), (0, 16), (2.5, 16)])
def test_greedy_choices_over_chunks(spark, gap, chunk):
    """Dense, sparse and tied candidates of two streams; scores on a slope depend on one another along the whole stream."""
    rng = random.Random(gap * 100 + chunk)
    streams = {"dense": [(i, rng.randrange(5)) for i in range(300)], "slope": [(i, i) for i in range(200)], "down": [(i, -i) for i in range(0, 200, 2)], "sparse": [(i, rng.random()) for i in sorted(rng.sample(range(2000), 60))], "one": [(5, 1.0)]}
    df = spark.createDataFrame([(s, i, float(v), i / 3) for s, rows in streams.items() for i, v in rows], "stream_id string, idx long, score double, t double").repartition(3)
    take = lambda d, c: {s: [r[c] for r in d.where(F.col("stream_id") == s).orderBy("idx").collect()] for s in streams}
    assert take(cp.earliest_first(df, gap, chunk=chunk), "idx") == {s: plain.earliest_first([i for i, _ in r], gap, 0.0) for s, r in streams.items()}
    assert take(cp.earliest_first(df, gap / 3, "t", None, chunk), "t") == {s: plain.earliest_first([i / 3 for i, _ in r], gap / 3, float("-inf")) for s, r in streams.items()}
    assert take(cp.strongest_first(df, gap, "score", chunk=chunk), "idx") == {s: plain.strongest_first(r, gap) for s, r in streams.items()}


def test_a_million_candidates_closer_than_the_gap(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("stream_id"), F.col("id").alias("idx"), (F.xxhash64("id") % 1000).cast("double").alias("score"))
    kept = cp.earliest_first(df, 10)
    assert kept.count() == (n - 1) // 10 and kept.where("idx % 10 <> 0 or idx = 0").isEmpty()
    strong = {r.idx for r in cp.strongest_first(df, 10, "score").select("idx").collect()}
    # none is close to another, and each one left out is close to one that is at least as strong
    places = np.array(sorted(strong))
    assert np.diff(places).min() >= 10
    score = np.array([r.score for r in df.orderBy("idx").select("score").collect()])
    best = np.full(n, -1e9)
    for d in range(-9, 10):
        at = places + d
        ok = (at >= 0) & (at < n)
        best[at[ok]] = np.maximum(best[at[ok]], score[places[ok]])
    assert (best >= score).all()


def test_one_candidate_is_none(spark):
    s = stream(spark, range(50))
    assert [r.t for r in cp.boundaries(s, candidates(spark, [20]), 5).orderBy("t").collect()] == [0, 49]
    assert [r.t for r in cp.boundaries(s, candidates(spark, [20, 30]), 5).orderBy("t").collect()] == [0, 20, 30, 49]


@pytest.mark.parametrize(("window", "hop"), [(8, 4), (8, 8), (6, 9), (88, 22)])
def test_frames(spark, window, hop):
    got = {r.frame_id: r.samples for r in frames.hopping(stream(spark, NOISE), window, hop, per_chunk=5).collect()}
    n = 1 + (len(NOISE) - window) // hop
    assert got == {i: NOISE[i * hop : i * hop + window].tolist() for i in range(n)}
    assert Frames().samples(44100) == (88, 22)


def segment_rows(spark, streams, names):
    """streams: name -> matrix; shuffled rows of stream_id, seg_id and the columns."""
    rows = [(s, i, *map(float, v)) for s, x in streams.items() for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "stream_id string, seg_id long, " + ", ".join(f"{c} double" for c in names)).repartition(5)


def labels_of(df):
    got = {}
    for r in df.orderBy("seg_id").collect():
        got.setdefault(r.stream_id, []).append(r.label)
    return got


def test_kmeans_is_the_plain_one(spark):
    rng = np.random.default_rng(1)
    groups = lambda n, centers, spread: np.concatenate([rng.normal(c, spread, (n, 6)) for c in centers])
    streams = {
        "far": groups(12, (200, 3000, 9000), 5), "noise": rng.normal(size=(300, 6)), "near": groups(100, (10, 12, 15), 2.0), "few": rng.normal(size=(2, 6)), "one": rng.normal(size=(1, 6)),
        "same": np.ones((5, 6)), "two": np.repeat([[1.0] * 6, [2.0] * 6], 4, 0), "flat": np.concatenate((rng.normal(size=(40, 3)), np.ones((40, 3))), 1),
    }
    for clusters in (None, 5):
        got = labels_of(cluster.kmeans_pp(segment_rows(spark, streams, cluster.FEATURES), clusters=clusters))
        assert got == {s: plain.kmeans_labels(x, clusters).tolist() for s, x in streams.items()}
    assert labels_of(cluster.kmeans_pp(segment_rows(spark, {"far": streams["far"]}, cluster.FEATURES)))["far"] == [0] * 12 + [1] * 12 + [2] * 12
    assert cluster.kmeans_pp(segment_rows(spark, streams, cluster.FEATURES).limit(0)).count() == 0


def test_kmeans_of_levels_is_the_plain_one(spark):
    rng = np.random.default_rng(2)
    pairs = lambda n, at, spread: np.stack([rng.normal(a, s, n) for a, s in zip(at, spread, strict=True)], 1)
    streams = {
        "three": np.concatenate((pairs(30, (500, -20), (50, 1)), pairs(30, (4000, -10), (50, 1)), pairs(2, (4400, -11), (5, 0.1)))), "noise": pairs(200, (1000, -20), (300, 5)), "one": pairs(1, (1, 1), (1, 1)),
        "same": np.ones((7, 2)), "two": np.repeat([[100.0, -3.0], [9000.0, -4.0]], [1, 40], 0),
    }
    df = segment_rows(spark, streams, ["centroid", "rms_db"])
    for clusters in (None, 4):
        assert labels_of(cluster.kmeans_levels(df, clusters=clusters)) == {s: plain.level_labels(x, clusters).tolist() for s, x in streams.items()}


def test_labels_do_not_depend_on_partitions(spark):
    df = segment_rows(spark, {s: np.random.default_rng(2).normal(size=(30, 6)) for s in "ab"}, cluster.FEATURES)
    pick = lambda d: sorted((r.stream_id, r.seg_id, r.label) for r in cluster.kmeans_pp(d, clusters=3).collect())
    assert pick(df.repartition(1)) == pick(df.repartition(7).orderBy(F.rand(3)))


def test_merging(spark):
    t0, t1, x = plain.merged_short([0, 10, 12, 30], [10, 12, 30, 31], np.array([[1.0], [2.0], [9.0], [9.0]]), 5)
    assert (t0, t1) == ([0, 12], [12, 31]) and np.allclose(x[:, 0], [(10 + 2 * 2) / 12, 9])
    x = np.array([[1000.0, -20]] * 5 + [[1200.0, -21]] + [[5000.0, -5]] * 5)
    assert plain.merged_small(x, np.array([0] * 5 + [1] + [2] * 5)).tolist() == [0] * 6 + [2] * 5
    rng = np.random.default_rng(5)
    given = {f"s{n}": (np.cumsum([0.0, *rng.choice([1.0, 2.0, 7.0, 30.0], n, p=[0.4, 0.3, 0.2, 0.1])]), rng.normal(size=(n, 2)).round(1)) for n in (1, 2, 3, 4, 5, 9, 60, 61, 400)}
    rows = [(s, i, float(t[i]), float(t[i + 1]), *map(float, f[i])) for s, (t, f) in given.items() for i in range(len(f))]
    df = spark.createDataFrame(rows, "stream_id string, seg_id long, t0 double, t1 double, a double, b double").repartition(4)
    for shortest in (5.0, 1.5, 1e9):
        got = {}
        for r in cluster.merge_short(df, ["a", "b"], shortest).orderBy("seg_id").collect():
            got.setdefault(r.stream_id, []).append(r[1:])
        for s, (t, f) in given.items():
            t0, t1, x = plain.merged_short(t[:-1].tolist(), t[1:].tolist(), f, shortest)
            assert np.allclose(got[s], np.column_stack((np.arange(len(t0)), t0, t1, x)))


def test_merging_small_clusters(spark):
    rng = np.random.default_rng(6)
    streams = {f"s{i}": (rng.normal((2000, -10), (600, 5), (40, 2)), rng.choice(9, 40, p=[0.3, 0.3, 0.2, 0.1, 0.02, 0.02, 0.02, 0.02, 0.02])) for i in range(12)}
    rows = [(s, i, *map(float, x[i]), int(k[i])) for s, (x, k) in streams.items() for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id string, seg_id long, hz double, db double, label int")
    got = labels_of(cluster.merge_small_clusters(df, ("hz", "db")))
    assert got == {s: plain._by_mean(plain.merged_small(x, k), x[:, 0]).tolist() for s, (x, k) in streams.items()}


def test_leaders_of_a_long_stream(spark):
    rng = np.random.default_rng(7)
    streams = {"a": rng.choice([1.0, 2.0, 5.0, 9.0], 500), "b": rng.normal(0, 50, 400).round(2), "c": [3.0]}
    df = segment_rows(spark, {s: np.array(v)[:, None] for s, v in streams.items()}, ["v"])
    for radius in (0.5, 3.0, 0.0):
        got = {}
        for r in cluster.leaders(df, "v", radius).orderBy("seg_id").collect():
            got.setdefault(r.stream_id, []).append(r.cluster_id)
        assert got == {s: plain.leaders(list(v), radius) for s, v in streams.items()}
    n = 1_000_000
    long = spark.range(n).select(F.lit("s").alias("stream_id"), F.col("id").alias("seg_id"), (F.col("id") % 7 * 100.0).alias("v"), F.col("id").cast("double").alias("t0"), (F.col("id") + 1.0).alias("t1"))
    assert cluster.leaders(long, "v", 10.0).where("cluster_id <> seg_id % 7").isEmpty()
    merged = cluster.merge_short(long, ["v"], 2.0)
    assert merged.where("t1 - t0 < 2").isEmpty() and merged.agg(F.sum(F.col("t1") - F.col("t0"))).first()[0] == n


def test_splicing_and_rebuilding(spark):
    n, k = 120, 3
    tracks = spark.createDataFrame([(t, i, float(1000 * t + i)) for t in range(k) for i in range(n)], "track int, idx long, x double")
    rounds = reconstruct.random_rounds(spark, n, 7, 19, 1)
    spans = sorted((r.i0, r.i1) for r in rounds.collect())
    assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(7 <= b - a <= 19 for a, b in spans[:-1])
    mixed = reconstruct.interleaved_by(tracks, k, rounds).orderBy("out_idx").collect()
    assert [r.out_idx for r in mixed] == list(range(n * k))
    assert [(r.track, r.idx) for r in mixed] == [(t, i) for a, b in spans for t in range(k) for i in range(a, b)]
    signal = spark.createDataFrame([("s", r.out_idx, r.x) for r in mixed], "stream_id string, idx long, x double")
    pieces = [(t, k * a + t * (b - a), b - a) for a, b in spans for t in range(k)]
    segs = spark.createDataFrame([("s", i, float(at), float(at + m), at, at + m, t) for i, (t, at, m) in enumerate(pieces)], "stream_id string, seg_id long, t0 double, t1 double, i0 long, i1 long, label int")
    rebuilt = reconstruct.concatenated(signal, segs).orderBy("label", "out_idx").collect()
    assert [r.x for r in rebuilt] == [float(1000 * t + i) for t in range(k) for i in range(n)]
    sums = reconstruct.masked(signal, segs, [0, 1, 2]).groupBy("idx").agg(F.sum("x").alias("x")).orderBy("idx").collect()
    assert [r.x for r in sums] == [r.x for r in mixed]
    assert segments.truth_hits(segs.select("stream_id", F.col("t0").alias("t")), segs.select("stream_id", (F.col("t0") + 1).alias("t")), 2.0).first().hit_rate == 1.0


def spliced(rng, rate=44100, blocks=24):
    """Blocks of a low and a high tone by turns, and the borders between them."""
    x, owner = [], []
    for i in range(blocks):
        n = int(rng.integers(1500, 3000))
        tone = np.sin(2 * np.pi * (600, 7000)[i % 2] * np.arange(n) / rate) * (0.8, 0.5)[i % 2]
        x.append(tone + rng.normal(size=n) * 0.01)
        owner.append(np.full(n, i % 2))
    return np.concatenate(x), np.concatenate(owner)


@pytest.mark.parametrize("fused", [False, True])
def test_deinterleaving_of_known_splices(spark, fused):
    """Recall and precision of borders, and the share of samples whose label is their source's."""
    x, owner = spliced(np.random.default_rng(6))
    signal = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "stream_id string, idx long, x double").repartition(4)
    truth = np.flatnonzero(np.diff(owner)) + 1
    labelled = pipelines.fused_segments(signal, 0.95) if fused else pipelines.labelled_segments(signal, None, 0.01)
    segs = labelled.toPandas()
    found = np.unique(np.concatenate((segs["i0"], segs["i1"])))
    label = np.full(len(x), -1)
    for r in segs.itertuples():
        label[r.i0 : r.i1] = r.label
    share = sum(np.bincount(owner[label == k], minlength=2).max() for k in set(label[label >= 0])) / len(x)
    assert share > 0.95
    tracks = (pipelines.fused_tracks(signal, 0.95) if fused else pipelines.deinterleaved(signal, None, 0.01)).groupBy("idx").agg(F.sum("x").alias("x"), F.count("*").alias("n"), F.collect_set("label").alias("labels"))
    # one track for each label that occurs, and no sample twice
    assert tracks.count() == len(x) and tracks.where(F.col("n") != segs["label"].nunique()).isEmpty()
    heard = {r.idx: r.x for r in tracks.select("idx", "x").collect()}
    assert all(heard[i] == (x[i] if label[i] >= 0 else 0.0) for i in range(0, len(x), 7))
    hit = [np.abs(found - t).min() <= 220 for t in truth]
    assert np.mean(hit) >= 0.9
    inner = [t for t in set(found.tolist()) if 0 < t < len(x) - 200]
    # a percentile of all frames marks a fixed share of them, so one detector alone is not precise
    assert np.mean([np.abs(truth - t).min() <= 220 for t in inner]) >= (0.5 if fused else 0.25)


def test_whole_spectrum_is_the_transform(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=997)  # a prime length
    signal = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "stream_id string, idx long, x double").repartition(3)
    got = {r.k: r.magnitude for r in spectral.whole_spectrum(signal, 997.0, 100.0, 300.0).collect()}
    whole = np.abs(np.fft.rfft(x))
    assert sorted(got) == list(range(100, 301)) and np.allclose([got[k] for k in sorted(got)], whole[100:301])
