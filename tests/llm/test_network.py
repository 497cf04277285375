"""The byte network against explicit loops, and its gradients against differences."""

import zlib

import numpy as np

from gridloom.llm import quality


def plain_score(net, text):
    """Every filter at every place of every chunk by loops."""
    raw = text.encode("utf-8", "surrogatepass")
    step, p = quality.CHUNK - quality.OVERLAP, net.p
    n = max(1, -(-(len(raw) - quality.OVERLAP) // step))
    tops = []
    for i in range(n):
        chunk = raw[i * step : i * step + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        top = []
        for f in range(quality.FILTERS):
            best = -np.inf
            for at in range(0, quality.CHUNK - 2 * quality.STRIDE + 1, quality.STRIDE):
                seen = sum(float(p["embed"][chunk[at + k]] @ p["filters"][k * quality.DIM : (k + 1) * quality.DIM, f]) for k in range(2 * quality.STRIDE))
                best = max(best, seen)
            top.append(max(0.0, best + float(p["bias"][f])))
        tops.append(top)
    features = [max(t[f] for t in tops) for f in range(quality.FILTERS)] + [sum(t[f] for t in tops) / n for f in range(quality.FILTERS)]
    z = sum(x * float(w) for x, w in zip(features, p["out"])) + float(p["out_bias"][0])
    return 1 / (1 + np.exp(-z))


def test_scores_by_loops():
    net = quality.ByteConvNet(3)
    texts = ["", "short", "é" * 300, "A longer text of several chunks. " * 40]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_chunks_cover_the_text():
    for n in (0, 1, 64, 511, 512, 513, 960, 961, 5000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        found, step = quality.chunks(text), quality.CHUNK - quality.OVERLAP
        joined = b"".join(r[:step].tobytes() for r in found[:-1]) + found[-1].tobytes()
        assert joined.rstrip(b"\0").decode() == text and len(found) == max(1, -(-(n - quality.OVERLAP) // step))


def test_gradients_by_differences():
    net = quality.ByteConvNet(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    draw = np.random.default_rng(0)  # texts without repeats, so that a maximum is at one place
    docs = [quality.chunks("".join("etaoinshrdlu zo"[i] for i in draw.integers(0, 15, n))) for n in (900, 7, 320)]
    y, starts, x = np.array([1.0, 0.0, 1.0]), np.cumsum([0, *map(len, docs)])[:-1], np.concatenate(docs)

    def loss():
        top = net.pooled(x)
        n = np.diff(np.r_[starts, len(top)])[:, None]
        z = np.hstack([np.maximum.reduceat(top, starts), np.add.reduceat(top, starts) / n]) @ net.p["out"] + net.p["out_bias"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = net._gradients(x, starts, y)
    for name, g in found.items():
        flat = net.p[name].reshape(-1)
        for i in draw.choice(len(flat), min(6, len(flat)), replace=False) if name != "embed" else [ord("o") * quality.DIM, ord("z") * quality.DIM + 3]:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-4 + 0.02 * abs(g.reshape(-1)[i]), (name, i)


def test_training_rows(spark):
    """Repeated ids, null ids, labels of one class or none, and the bounds of the sample."""
    a, b, c = [k for k in range(1, 50) if zlib.crc32(str(k).encode()) % 3 != 1][:3]
    docs = spark.createDataFrame([(a, "good good"), (a, "good good"), (b, "bad"), (None, "x"), (c, None)], "doc_id long, text string").selectExpr("*", "9 as y", "8 as upto")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels([])) == 0.5 and quality.train(docs, labels([(b, 1, 0), (c, 1, 0), (None, 0, 0), (b, 7, 0)])) == 1.0
    assert quality.train(docs, labels([(a, 1, 0), (a, 0, 0)])) == 0.0
    net = quality.train(docs, labels([(a, 1, 0), (b, 0, 0), (c, 1, 0)]))
    got = quality.quality_scores(docs, net).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted([0, a, a, b, c]) and all(0 <= r["score"] <= 1 for r in got)
    assert not isinstance(quality.train(docs, labels([(a, 1, 0), (b, 0, 0), (c, 0, 0)]), sample_bytes=1), quality.ByteConvNet)
