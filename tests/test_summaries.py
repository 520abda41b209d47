"""Summaries of runs: missing counts, several controls, odd scores, empty tables."""

import numpy as np
import pytest

from larkspur.plans import summaries as S
from larkspur.sources import files


def f_macro(pairs):
    """Mean F1 of both classes."""
    found = []
    for cls in (0, 1):
        both = sum(p == t == cls for p, t in pairs)
        n = sum(p == cls for p, _ in pairs) + sum(t == cls for _, t in pairs)
        found.append(2 * both / n if n else 0.0)
    return np.mean(found)


def test_summary_of_classifiers(spark):
    rng = np.random.default_rng(1)
    rows = [(c, "a" if i % 2 else None, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for c in ("x", "y") for i in range(40)] + [("z", "a", 1, 1)] * 3
    got = {(r.concept, r.control): r for r in S.classifier_summary(spark.createDataFrame(rows, "concept string, control string, pred int, truth int"), "concept", "control").collect()}
    assert len(got) == 5
    for (concept, control), r in got.items():
        own = [(p, t) for c, k, p, t in rows if (c, k) == (concept, control)]
        assert np.isclose(r.fscore, f_macro(own)) and (r.support_0, r.support_1) == (sum(t == 0 for _, t in own), sum(t == 1 for _, t in own))
    assert got["z", "a"].fscore == 0.5 and got["z", "a"].precision_0 == 0.0


def test_slopes_over_insertions(spark, tmp_path):
    """Planted F-scores in text files of three runs, with comment lines; slopes, order, missing counts and the threshold."""
    right = {"rising": (5, 7, 10), "flat": (10, 10, 10), "gone": (10, 10, None), "weak": (5, 5, 5), "late": (None, 10, 10)}
    counts = [4, 8, 16]
    for i, n in enumerate(counts):
        rows = [(c, k, t if j < hits[i] else 1 - t, t) for c, hits in right.items() if hits[i] is not None for k in ("one", "two") for j in range(10) for t in (0, 1)]
        files.write_prediction_folders(spark.createDataFrame(rows, "concept string, control string, pred int, truth int"), f"{tmp_path}/{n}")
    part = sorted((tmp_path / "4").glob("folder=flat_control_one/*.csv"))[0]
    part.write_text("# accuracy 1.0\n" + part.read_text())
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    read = S.insertion_predictions(spark, {n: f"{tmp_path}/{n}/*" for n in counts})
    found = S.insertion_slopes(S.classifier_summary(read, "concept", "control", "insertions"), counts, 0.9).collect()
    assert [r.concept for r in found] == ["gone", "flat", "rising"]  # no slope comes first
    assert found[0].slope is None and found[0].fscore_16 is None and found[1].slope == pytest.approx(0)
    slope, _ = np.polyfit(counts, [0.5, 0.7, 1.0], 1)
    assert found[2].slope == pytest.approx(slope) and found[2].r2 == pytest.approx(np.corrcoef(counts, [0.5, 0.7, 1.0])[0, 1] ** 2)


def test_ratios_of_several_attributions(spark):
    rows = [("first", "x", False, s) for s in (1.0, 2.0, -1.0, 0.0)] + [("first", "x", True, s) for s in (1.0, -1.0, float("nan"), None)] + [("second", "x", False, 3.0), ("second", "y", None, 1.0)]
    scores = spark.createDataFrame(rows, "attribution string, concept string, is_control boolean, score double")
    got = {(r.attribution, r.concept): r for r in S.attribution_ratios(scores).collect()}
    assert set(got) == {("first", "x"), ("second", "x")}
    one = got["first", "x"]
    assert (one.target_share, one.control_share) == (0.5, 0.5) and one.log_ratio == pytest.approx(0)
    assert got["second", "x"].target_share == 1 and got["second", "x"].log_ratio is None
    assert S.attribution_ratios(scores.limit(0)).count() == 0
    assert S.classifier_summary(spark.createDataFrame([], "concept string, pred int, truth int"), "concept").count() == 0


def test_attributions_take_little_memory_at_once():
    """The arrays of a slice of the largest size, traced; batches of any size are cut to it."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from larkspur.operators import attribution as A
    from larkspur.plans import linear_queries as Q

    layers, rng = Q.sequence_network(), np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array(["".join(rng.choice(list("ACGT"), 64)) for _ in range(5_000)])], names=["seq"])
    parts = list(A._slices(iter([batch]), layers))
    assert sum(p.num_rows for p in parts) == 5_000
    tracemalloc.start()
    x = A.inputs(parts[0].column("seq"), layers)
    A.multipliers(x, x[::-1], layers)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_runs_read_texts_once(spark):
    """Sequences of a run are stored evenly: the same rows, in more than one part, and plans on them don't read the documents."""
    from larkspur.plans import proxies as P

    sf = "/root/testdata/sf0.001"
    stored = P.stored_sequences(spark, sf)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, P.sequences(spark, sf).collect()), key=str)
    assert not any("documents" in f for f in stored.inputFiles()) and len(stored.inputFiles()) > 4
    ours, theirs = ({(r.motif, r.pos): r[2:] for r in x.collect()} for x in (P.pwm(spark, sf, stored), P.pwm(spark, sf)))
    assert ours == theirs
