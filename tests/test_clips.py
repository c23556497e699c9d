"""WAVE files read and written, the cache of embeddings, and the head with a hidden layer."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.operators import clips, evaluate
from nocturne.sources import clips as source


def wav(kind, bits, channels, rate, body, extra=b"", extensible=False):
    fmt = struct.pack("<HHIIHH", source.EXTENSIBLE if extensible else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + b"\0" * 14
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_formats_are_decoded():
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0])
    assert np.array_equal(source.decode_wav(source.encode_wav(x, 8000))[1], x)
    for kind, bits, body in (
        (1, 8, (x * 128 + 128).astype("u1").tobytes()),
        (1, 16, (x * (1 << 15)).astype("<i2").tobytes()),
        (1, 24, b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x)),
        (1, 32, (x * (1 << 31)).astype("<i4").tobytes()),
        (3, 32, x.astype("<f4").tobytes()),
        (3, 64, x.astype("<f8").tobytes()),
    ):
        for extensible in (False, True):
            rate, got = source.decode_wav(wav(kind, bits, 1, 44100, body, b"LIST\x03\0\0\0abc\0", extensible))
            assert rate == 44100 and np.array_equal(got, x)
    stereo = np.stack([x, x / 2], 1).ravel()
    assert np.array_equal(source.decode_wav(wav(3, 64, 2, 16000, stereo.astype("<f8").tobytes()))[1], x * 0.75)


@pytest.mark.parametrize("data", [b"", b"RIFF", b"junk" * 20, wav(7, 8, 1, 8000, b"ab"), wav(1, 16, 0, 8000, b"ab"), b"RIFF\0\0\0\0WAVEdata\x02\0\0\0ab", source.encode_wav(np.zeros(3), 8000)[:36]])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        source.decode_wav(data)


def test_cache_embeds_what_is_new_or_changed(spark, tmp_path):
    root = tmp_path / "clips"
    done = []
    for label in ("cry", "noise"):
        (root / label).mkdir(parents=True)
        for i in range(3):
            (root / label / f"g{i}-{i}.wav").write_bytes(source.encode_wav(np.full(80, (i + 1) / 8), 8000))
    (root / "cry" / "broken.wav").write_bytes(b"RIFFnothing")

    def embed(heard):
        done.append(heard.count())
        return heard.withColumn("embedding", F.array(F.element_at("samples", 1).cast("double"), F.size("samples").cast("double")))

    run = lambda: source.add_to_cache(source.index_clip_dir(spark, str(root)), str(tmp_path / "cache"), embed, 16000)
    first = {r["path"].rsplit("/", 2)[-1] + r["label"]: tuple(r["embedding"]) for r in run().collect()}
    assert len(first) == 6 and set(first.values()) == {(0.125, 160.0), (0.25, 160.0), (0.375, 160.0)}
    assert run().count() == 6
    changed = root / "cry" / "g1-1.wav"
    changed.write_bytes(source.encode_wav(np.full(80, -0.5), 8000))
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    after = run()
    assert after.count() == 7 and after.where("path LIKE '%cry/g1-1.wav'").count() == 2
    assert done == [6, 0, 1]
    errors = source.with_samples(source.index_clip_dir(spark, str(root))).where("error IS NOT NULL").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in errors] == ["broken.wav"] and errors[0]["samples"] is None


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(20, 4)), rng.integers(0, 3, 20), rng.uniform(0.5, 2, 20)
    weights = [rng.normal(size=s) for s in ((4, 5), (5,), (5, 3), (3,))]
    _, gradient = clips._backwards(x, y, w, weights)
    for k, g in enumerate(gradient):
        for at in np.ndindex(g.shape):
            loss = []
            for e in (1e-6, -1e-6):
                moved = [v.copy() for v in weights]
                moved[k][at] += e
                loss.append(clips._backwards(x, y, w, moved)[0])
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-4)


def test_hidden_layer_learns_what_no_line_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    rows = [("same" if a * b > 0 else "other", [float(a), float(b)]) for a, b in x] + [(None, [1.0, 1.0]), ("same", None)]
    df = spark.createDataFrame(rows, "label string, embedding array<double>").repartition(4)
    head = clips.train_hidden_head(df, hidden=24, epochs=25, batches=1, rate=0.05, dropout=0.1, patience=25)
    told = clips.predict_hidden_head(head, df)
    assert told.where("embedding IS NULL AND pred IS NULL AND confidence IS NULL").count() == 1
    known = told.where("label IS NOT NULL AND pred IS NOT NULL")
    line = clips.predict_head(clips.train_head(df.where("label IS NOT NULL AND embedding IS NOT NULL")), df.where("label IS NOT NULL AND embedding IS NOT NULL"))
    f1 = lambda t: evaluate.classification_report(t, "label", "pred").first()["macro_f1"]
    assert f1(known) > 0.9 > 0.7 > f1(line)
    assert head.losses[-1] < head.losses[0]
