"""Injected classifiers with stubs, the outcomes of their answers, and the evaluation of bursts."""

import numpy as np
from pyspark.sql import functions as F

from plumage.operators import burst, detection, evaluation, focus, recognition, refine

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def images(spark, *rows):
    return spark.createDataFrame([((name, h, w, 3, 16, data),) for name, h, w, data in rows], IMAGE)


def shade(value, h=60, w=80):
    return bytes([value]) * (h * w * 3)


def boxes_by_shade():
    """As many birds as the first byte says, one beside the other."""

    def model(pixels, conf):
        n = int(pixels[0, 0, 0])
        return [(10 * i, 5, 10 * i + 8, 20, 0.9, 14) for i in range(min(n, 7))] + ([(500, 500, 510, 510, 0.9, 14)] if n == 7 else [])

    return model


def test_crops_of_many_images_share_batches_and_find_their_boxes(spark, tmp_path):
    log = str(tmp_path / "batches")

    def classifier():
        def model(crops):
            with open(log, "a") as file:
                file.write(f"{len(crops)}\n")
            assert crops.shape[1:] == (3, 224, 224) and crops.dtype == np.float32
            value = crops[:, 0].mean(axis=(1, 2)) * 0.229 + 0.485
            return np.stack([value, np.zeros(len(crops)), -value], axis=1)

        return model

    rows = images(spark, *[(f"i{n:02}", 60, 80, shade(n)) for n in (3, 0, 2, 1, 7, 5)], ("short", 60, 80, b"x"), ("none", -1, -1, None)).coalesce(1)
    size = 4 * 3 * 224 * 224
    found = {r.path: r for r in recognition.classified(rows, boxes_by_shade, classifier, batch_bytes=4 * size).collect()}
    assert set(found) == {"i03", "i00", "i02", "i01", "i07", "i05", "short", "none"}
    for n in (3, 0, 2, 1, 7, 5):
        birds = found[f"i{n:02}"].birds
        real = [b for b in birds if b.x1 < 500]
        assert len(real) == n and all(abs(b.logits[0] - n / 255) < 1e-5 for b in real)
        assert all(b.logits is None for b in birds if b.x1 >= 500)  # its crop is empty
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) == 18 and sizes == [4, 4, 4, 4, 2]  # batches go across images


def test_a_fault_costs_one_crop(spark):
    def classifier():
        def model(crops):
            if (np.rint((crops[:, 0].mean(axis=(1, 2)) * 0.229 + 0.485) * 255) == 2).any():
                raise ValueError("two")
            return np.ones((len(crops), 2))

        return model

    found = {r.path: r for r in recognition.classified(images(spark, *[(f"i{n}", 60, 80, shade(n)) for n in (1, 2, 3)]).coalesce(1), boxes_by_shade, classifier).collect()}
    assert found["i2"].error == "ValueError: two" and [b.logits for b in found["i2"].birds] == [None, None]
    assert [b.logits for b in found["i3"].birds] == [[1.0, 1.0]] * 3 and found["i3"].error is None
    assert recognition.classified(images(spark), boxes_by_shade, classifier).count() == 0


def test_prepared_crops():
    ramp = np.repeat(np.arange(512, dtype=np.float64)[None, :, None] / 2, 256, axis=0).repeat(3, axis=2).astype(np.uint8)
    x = recognition.prepared(ramp)
    assert x.shape == (3, 224, 224)
    first, last = (x[0, 0, 0] * 0.229 + 0.485) * 255, (x[0, 0, -1] * 0.229 + 0.485) * 255
    assert abs(first - 72) < 1.1 and abs(last - 183.5) < 1.1  # the middle 224 of 512 columns
    blue = np.zeros((30, 20, 3), np.uint8)
    blue[:, :, 0] = 255
    assert recognition.prepared(blue)[2].min() > 2 and recognition.prepared(blue)[0].max() < -2  # planes are red, green, blue
    assert recognition.prepared(np.full((5, 900, 1), 9, np.uint8)).shape == (3, 224, 224)
    small = np.arange(16, dtype=np.uint8).reshape(4, 4, 1)
    assert (recognition.resized(small, 4, 4) == small).all() and (np.diff(recognition.resized(small, 2, 2).ravel()) > 0).all()
    assert np.allclose(recognition._weights(10, 3).sum(axis=1), 1) and np.allclose(recognition._weights(3, 10).sum(axis=1), 1)


def test_from_pixels_to_all_reasons(spark):
    """Every image shows one bird; its shade says how sure the classifier is."""

    def one_box():
        return lambda pixels, conf: [(0, 0, 80, 60, 0.9, 14)]

    answers = {10: [9.0, 0, 0, 0], 20: [0, 9.0, 0, 0], 30: [0, 0, 9.0, 0], 40: [0.2, 0.1, 0, 0], 50: [0, 0, 0, 9.0]}

    def classifier():
        return lambda crops: np.array([answers[int(np.rint((c[0].mean() * 0.229 + 0.485) * 255))] for c in crops])

    found = recognition.classified(images(spark, *[(f"i{n}", 60, 80, shade(n)) for n in answers]), one_box, classifier)
    boxes = recognition.detections(found)
    species = spark.createDataFrame([(0, "甲", "", ""), (1, "", "b", "B b"), (2, "", "", "")], "idx int, chinese_name string, english_name string, scientific_name string")
    raw = recognition.candidates(boxes, species, 1).withColumn("province", F.lit("P"))
    regional = spark.createDataFrame([("P", 0)], "region string, idx int")
    national = spark.createDataFrame([(0,), (1,), (2,)], "idx int")
    by = lambda rows: {r.image: r for r in rows.collect()}
    none = by(recognition.outcomes(boxes, raw, refine.refined(raw, regional, national)))
    assert none["i10"].accepted and (none["i10"].raw_count, none["i10"].post_count, none["i10"].raw_top_name) == (1, 1, "甲")
    assert none["i20"].accepted and none["i20"].raw_top_name == "b" and none["i30"].raw_top_name == recognition.UNKNOWN_NAME  # sure, so admitted off the list
    assert none["i40"].accepted and none["i50"].unknown_reason == "no_model_candidates"
    unlisted = by(recognition.outcomes(boxes, raw, refine.refined(raw.withColumn("confidence", F.lit(0.5)), regional, national)))
    assert unlisted["i20"].unknown_reason == "all_candidates_removed_by_geo_rules" and unlisted["i10"].accepted
    low = by(recognition.outcomes(boxes, raw, refine.refined(raw, regional, national, threshold=0.6), 0.6))
    assert low["i40"].unknown_reason == "all_candidates_filtered_below_unknown_kind_threshold" and low["i40"].detail.endswith("(< 0.600)")
    later = by(recognition.outcomes(boxes, raw, refine.refined(raw, regional, national), 0.6))
    assert later["i40"].unknown_reason == "top1_conf_below_min_accept" and later["i40"].detail == f"top1_conf_below_min_accept ({later['i40'].post_top_confidence:.3f} < 0.600)"
    spared = by(recognition.outcomes(boxes, raw, refine.refined(raw, regional, national), 0.6, spark.createDataFrame([("i40", 0, False)], "image string, det int, is_bird boolean")))
    assert spared["i40"].accepted
    fifth = refine.accepted(spark.createDataFrame([(1, 1, 0.9, True, 0)], "raw_count int, post_count int, top_confidence double, is_bird boolean, kept_count int"), None).first()
    assert fifth.unknown_reason == "all_candidates_filtered_after_geo_refine" and not fifth.accepted


def sharp(seed, h=60, w=80):
    return np.random.default_rng(seed).integers(0, 255, (h, w, 3), dtype=np.uint8)


def frames(spark, n, camera="c"):
    rows = [(camera, i * 100_000, f"{camera}{i:02}") for i in range(n)]
    return burst.sessions(spark.createDataFrame(rows, "camera string, us long, path string"), 1.0)


def counting_decoder(log):
    def factory():
        def decode(content):
            with open(log, "a") as file:
                file.write(content[:3].decode() + "\n")
            if content[3:] == b"bad":
                raise ValueError("not an image")
            return sharp(int(content[1:3])) // (1 + int(content[1:3]) % 4)

        return decode

    return factory


def test_only_planned_files_are_decoded(spark, tmp_path):
    log = str(tmp_path / "decoded")
    files = spark.createDataFrame([(f"{c}{i:02}", f"{c}{i:02}".encode()) for c in "cdx" for i in range(9)], "path string, content binary")
    both = frames(spark, 9).unionByName(frames(spark, 2, "d"))
    out = {r.path: r for r in evaluation.evaluated(both, files, counting_decoder(log), fast=True).collect()}
    assert sorted(line.strip() for line in open(log)) == ["c00", "c03", "c06"]  # neither frames kept whole, nor estimated ones, nor others in the folder
    assert [out[f"c{i:02}"].plan for i in range(3)] == ["measure", "estimate", "estimate"] and out["d00"].plan == "whole"
    assert out["d00"].keep and out["d01"].keep and sum(r.keep for r in out.values()) == 4
    assert abs(out["c02"].focus - 0.95 * out["c03"].focus) < 1e-12 and out["c00"].focus > 0
    terms = focus.focus_terms(focus.gray_of(sharp(0).tobytes(), 60, 80, 3))
    assert abs(out["c00"].focus - (np.log1p(terms[0]) + 0.55 * np.log1p(terms[1]) + 0.35 * np.log1p(terms[2]) - terms[3])) < 1e-9


def test_subjects_decide_where_a_detector_runs(spark, tmp_path):
    log = str(tmp_path / "decoded")
    files = spark.createDataFrame([(f"c{i:02}", f"c{i:02}".encode() + (b"bad" if i == 4 else b"")) for i in range(6)], "path string, content binary")
    outline = [(20, 10), (60, 10), (60, 50), (20, 50)]

    def birds():
        def model(pixels, conf):
            if pixels.max() < 70:
                return [(0, 0, 20, 20, 0.9, 14)]  # too small
            return [(0, 0, 5, 5, 0.9, 14), (15, 5, 65, 55, 0.9, 14, outline), (0, 0, 80, 60, 0.9, 2)]

        return model

    rows = {r.path: r for r in evaluation.evaluated(frames(spark, 7), files, counting_decoder(log), birds, fast=True).collect()}
    assert len(open(log).readlines()) == 6  # with a detector none is estimated
    assert rows["c04"].error == "ValueError: not an image" and rows["c04"].decoded is False and rows["c06"].decoded is None
    assert [rows[f"c{i:02}"].eligible for i in range(7)] == [True, True, True, False, False, True, False]
    assert rows["c00"].area == 2500.0 and rows["c03"].area == 400.0 and rows["c03"].focus == 0.0 and rows["c03"].n_birds == 1
    pixels = sharp(0)
    ax, ay, bx, by = detection.grown_box((15, 5, 65, 55), 80, 60, focus.ROI_MARGIN)
    gray = focus.gray_of(pixels[ay:by, ax:bx].tobytes(), by - ay, bx - ax, 3)
    mask = focus.polygon_mask([(x - ax, y - ay) for x, y in outline], bx - ax, by - ay)
    want = focus.mask_terms(gray, mask)
    assert focus.subject_terms(pixels, (15, 5, 65, 55), [{"x": x, "y": y} for x, y in outline]) == want != focus.focus_terms(gray)
    assert focus.subject_terms(pixels, (15, 5, 65, 55), None) == focus.focus_terms(gray) == focus.subject_terms(pixels, (15, 5, 65, 55), [{"x": 0, "y": 0}])
    assert focus.subject_terms(pixels, (15, 5, 65, 55), mode="laplacian")[0] == focus.laplacian(gray).var() and focus.subject_terms(pixels, (90, 70, 95, 75)) is None
    assert abs(rows["c00"].focus - (np.log1p(want[0]) + 0.55 * np.log1p(want[1]) + 0.35 * np.log1p(want[2]) - want[3])) < 1e-9
    assert sum(r.keep for r in rows.values()) == 2


def test_evaluation_of_nothing(spark, tmp_path):
    files = spark.createDataFrame([], "path string, content binary")
    assert evaluation.evaluated(frames(spark, 1).filter("false"), files, counting_decoder(str(tmp_path / "x"))).count() == 0
    assert evaluation.evaluated(frames(spark, 1), files, counting_decoder(str(tmp_path / "x"))).first().focus == 0.0


def test_sampling_by_arithmetic(spark):
    rows = [(f"s{n}", i, f"p{i:04}") for n in range(1, 130) for i in range(n)]
    got = burst.sampled(burst.sessions(spark.createDataFrame(rows, "camera string, us long, path string"), 1.0)).filter("sampled").groupBy("n").agg(F.sort_array(F.collect_list("at")).alias("at")).collect()
    for r in got:
        count = max(3, r.n // 3)
        assert r["at"] == (list(range(r.n)) if r.n <= 3 else sorted({round(i * (r.n / count)) for i in range(count)} & set(range(r.n)))), r.n
