import numpy as np
import pytest

from dotframe.operators import jpeg, photo, sinks, train


def picture(h, w, seed=0):
    y, x = np.indices((h, w))
    image = np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (x * 3 + y) % 256], axis=-1)
    return np.clip(image + np.random.default_rng(seed).normal(0, 6, (h, w, 3)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(64, 64), (37, 51), (1, 1), (8, 200)])
def test_jpeg_is_read_back(spark, tmp_path, shape):
    image = picture(*shape)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(image, 95))
    (tmp_path / "b.jpg").write_bytes(jpeg.encode(np.full((*shape, 3), 200), 92))
    rows = {r.path.rsplit("/", 1)[1]: photo.pixels_of(r) for r in photo.read_photos(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"].shape == image.shape and np.abs(rows["a.jpg"].astype(int) - image).mean() < 6
    assert np.abs(rows["b.jpg"].astype(int) - 200).max() <= 2


def test_noise_needs_long_codes(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (160, 160, 3)).astype(np.uint8)
    image[:80] = 90
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(image, 100))
    got = photo.pixels_of(photo.read_photos(spark, str(tmp_path)).first())
    assert np.abs(got.astype(int) - image).mean() < 3


def test_photos_are_turned(spark, tmp_path):
    image = np.zeros((16, 32, 3), np.uint8)
    image[:, :16] = 250
    exif = b"Exif\0\0II*\0\x08\0\0\0\1\0\x12\1\3\0\1\0\0\0\6\0\0\0"
    content = jpeg.encode(image)
    (tmp_path / "a.jpg").write_bytes(content[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + content[2:])
    r = photo.read_photos(spark, str(tmp_path)).first()
    got = photo.pixels_of(r)
    assert got.shape == (32, 16, 3) and got[:14].min() > 200 and got[18:].max() < 50  # a quarter turn to the right


def test_tiles_and_crops(spark, tmp_path):
    image = picture(100, 120)
    photos = spark.createDataFrame([(1, 120, 100, image.tobytes())], photo.PHOTO)
    tiles = spark.createDataFrame([(1, "train", "s_tile0", 0, 0, 60, 60), (1, "val", "s_tile1", 60, 40, 120, 100)], "page_id long, split string, stem string, x0 int, y0 int, x1 int, y1 int")
    sinks.write_files(sinks.tile_files(photos, tiles), str(tmp_path))
    r = photo.read_photos(spark, str(tmp_path / "images/val")).first()
    assert np.abs(photo.pixels_of(r).astype(int) - image[40:100, 60:120]).mean() < 8
    cells = spark.createDataFrame([(1, "train", "s", 3, 10.6, 5.2, 42.9, 50.0, "100000", 1), (1, "train", "s", 4, 500.0, 5.0, 510.0, 9.0, "100000", 1)], "page_id long, split string, stem string, cell_idx int, x0 double, y0 double, x1 double, y1 double, bits6 string, label int")
    files = sinks.crop_files(photos, cells)
    assert [(r.name, r.split, r.bits6, r.label_int) for r in files.collect()] == [("train/s_0003.jpg", "train", "100000", 1)]
    sinks.write_files(files, str(tmp_path / "crops"))
    assert photo.read_photos(spark, str(tmp_path / "crops/train")).first().img_w == 64


def test_training_keeps_the_best_state(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    bits = ["".join("1" if v > 0 else "0" for v in r[:5]) + "1" for r in x]
    df = spark.createDataFrame([(r.tolist(), b) for r, b in zip(x, bits)] + [(None, "100000"), ([0.0] * 8, "x")], "features array<double>, bits6 string").repartition(3)
    model = train.fit_best(df, df, epochs=25, rate=0.2, checkpoint=str(tmp_path / "best.npz"))
    losses = [r["val_loss"] for r in model.log]
    again = train.LinearDots.load(str(tmp_path / "best.npz"))
    assert np.array_equal(again.weights, model.weights) and min(losses) < 0.2 and max(r["val_dot_acc"] for r in model.log) > 0.95
    train.write_log(model.log, str(tmp_path / "log.csv"))
    assert (tmp_path / "log.csv").read_text().startswith("epoch,train_loss,val_loss")
    worse = train.fit_best(df, df.selectExpr("features", "'000000' as bits6"), epochs=30, rate=5.0, patience=2, stop=4)
    assert len(worse.log) < 30 and worse.log[-1]["rate"] < 5.0


def test_export_gives_the_same_logits(tmp_path):
    ort = pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(0)
    model = train.LinearDots(rng.normal(size=(12, 6)), rng.normal(size=6))
    train.export_onnx(model, str(tmp_path / "m.onnx"))
    session = ort.InferenceSession(str(tmp_path / "m.onnx"), providers=["CPUExecutionProvider"])
    for n in (1, 7):
        batch = rng.normal(size=(n, 12)).astype(np.float32)
        (got,) = session.run(None, {"input": batch})
        assert np.abs(got - model(batch)).max() < 1e-5 and ((got > 0) == (model(batch) > 0)).all()


def test_augmentation_and_dataset(spark):
    image = picture(40, 40)
    out = train.augmented(image, np.random.default_rng(5))
    assert out.shape == image.shape and 0 <= out.min() and out.max() <= 255 and np.abs(out - image).mean() > 1
    crops = spark.createDataFrame([("p", image.tobytes(), 40, 40, "110000")], "path string, pixels binary, img_w int, img_h int, bits6 string")
    rows = {r.flip: r for r in train.crop_dataset(crops, training=True).collect()}
    assert rows[False].bits6 == "110000" and rows[True].bits6 == "000110" and len(rows[True].features) == 3 * 64 * 64
    assert [r.features for r in train.crop_dataset(crops, training=True).collect()] == [rows[False].features, rows[True].features]
    assert [r.flip for r in train.crop_dataset(crops, training=False).collect()] == [False]
