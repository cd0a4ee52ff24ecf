import numpy as np

from dotframe.operators import enhance, train


def board(h=120, w=160, box=(30, 20, 130, 90)):
    image = np.full((h, w), 60.0)
    image[box[1] : box[3], box[0] : box[2]] = 200
    return image


def test_equalise_spreads_and_keeps_order():
    image = np.tile(np.linspace(100, 140, 64), (64, 1))
    out = enhance.equalise(image, clip=40, grid=(1, 1))
    assert np.ptp(out) > 200 and (np.diff(out[0]) >= 0).all()
    mild = enhance.equalise(image, clip=1, grid=(1, 1))
    assert np.ptp(mild) < np.ptp(out)
    assert enhance.equalise(np.full((3, 3), 9.0)).shape == (3, 3)


def test_regions_and_filling():
    mask = np.zeros((9, 12), bool)
    mask[1:8, 1:8] = True
    mask[2:7, 2:7] = False
    mask[4, 10] = True
    of = enhance.regions(mask)
    assert of.max() == 2 and of[0, 0] == 0 and (of[mask] > 0).all()
    solid = enhance.filled(mask)
    assert solid.sum() == 49 + 1
    assert enhance.regions(np.ones((3, 3), bool)).min() == 1


def test_edges_only_at_the_outline():
    mask = enhance.edges(board())
    ys, xs = np.nonzero(mask)
    assert len(ys) and (np.minimum.reduce([abs(xs - 30), abs(xs - 129), abs(ys - 20), abs(ys - 89)]) <= 1).all()


def test_finds_the_container(spark):
    found = enhance.containers(board())
    assert len(found) == 1
    x0, y0, x1, y1, *_ = found[0]
    assert abs(x0 - 30) <= 3 and abs(y0 - 20) <= 3 and abs(x1 - 130) <= 3 and abs(y1 - 90) <= 3
    assert enhance.containers(np.full((50, 50), 7.0)) == []
    df = spark.createDataFrame([(1, board().tolist())], "photo_id long, image array<array<double>>")
    assert enhance.find_containers(df).count() == 1


def test_classifier_learns_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    bits = ["".join("1" if v > 0 else "0" for v in r[:5]) + "1" for r in x]
    df = spark.createDataFrame([(r.tolist(), b) for r, b in zip(x, bits)], "features array<double>, bits6 string").repartition(2)
    model = train.fit(df)
    score = train.evaluate(model, df).first()
    assert score.dot_acc > 0.95 and score.cell_acc > 0.8 and score.loss < 0.3
    log = train.log_rows(model)
    assert log and log[0]["train_loss"] >= log[-1]["train_loss"] or len(log) > 6
    model.save(str(tmp_path / "m"))
    again = train.evaluate(train.DotClassifier.load(str(tmp_path / "m")), df).first()
    assert abs(again.loss - score.loss) < 1e-9
