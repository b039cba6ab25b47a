import numpy as np

from wallscope.llm import op4_quality as op
from wallscope.llm import queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    learn, held = labels.where("doc_id % 4 <> 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 0").collect()}
    got = {r.doc_id: r for r in op.classify(docs, learn).collect()}
    assert len(got) == docs.count()
    clean = [got[i].kept for i, q in held.items() if q == 1]
    junk = [not got[i].kept for i, q in held.items() if q == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) > 0.85


def test_query_returns_every_document(spark):
    rows = queries.QUERIES["op4_quality"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(0 <= r.quality <= 1 and r.kept == (r.quality >= 0.5) for r in rows)


def test_the_views_exchange_labels():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1060)
    content = np.c_[y * 2 + rng.normal(0, 0.5, 1060), rng.normal(0, 1, 1060)]
    meta = np.c_[y * 2 + rng.normal(0, 0.5, 1060), rng.normal(0, 1, 1060)]
    views, pool = (content[:60], meta[:60]), (content[60:], meta[60:])
    model = op.cotrain(views, y[:60].astype(float), pool)
    assert np.mean((model.score(pool)[2] >= 0.5) == y[60:]) > 0.95


def test_odd_rows(spark):
    odd = [(1, None, None, None), (2, "", "s", "en"), (3, "x " * 200_000, "s", "en"), (3, "x", "s", "en"), (None, "y", "s", "en"), (4, "\n\n\n", "s", "en")]
    docs = spark.createDataFrame([(*r, 0.0) for r in odd], "doc_id long, text string, source string, lang string, quality double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        got = op.classify(docs, labels).collect()
        assert [(r.quality, r.kept) for r in got] == [(1.0, True)] * 6
        assert op.keep_good(docs, labels).columns == docs.columns
    model = op.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert op._score(docs, ["doc_id"], model).count() == 6
    assert op.classify(docs.limit(0), one).count() == 0


def test_labels_of_other_documents_play_no_part(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    others = spark.range(10_000_000, 10_200_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    rows = lambda found: sorted((r.doc_id, round(r.quality, 9)) for r in found.collect())
    alone = rows(op.classify(docs, labels))
    assert rows(op.classify(docs, labels.select("doc_id", "quality", "toxic").union(others))) == alone
    assert sum(q < 0.5 for _, q in alone) > 50


def plain_fit(x, y, ridge=1.0):
    """Logistic regression by gradient descent with a line search, one row at a time."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = [[*((v - m) / s for v, m, s in zip(row, mean, scale)), 1.0] for row in x]
    w = [0.0] * len(z[0])

    def loss(w):
        total = sum(np.log1p(np.exp(-abs(t))) + max(t, 0) - t * label for t, label in ((sum(a * b for a, b in zip(w, row)), label) for row, label in zip(z, y)))
        return total + ridge / 2 * sum(a * a for a in w[:-1])

    rate = 1.0
    for _ in range(4000):
        slope = [ridge * a for a in w[:-1]] + [0.0]
        for row, label in zip(z, y):
            gap = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, row)))) - label
            slope = [s + gap * v for s, v in zip(slope, row)]
        size = sum(s * s for s in slope)
        if size < 1e-14:
            break
        rate *= 2
        while loss([a - rate * s for a, s in zip(w, slope)]) > loss(w) - rate * size / 2 and rate > 1e-12:
            rate /= 2
        w = [a - rate * s for a, s in zip(w, slope)]
    return lambda rows: np.array([sum(a * (v - m) / s for a, v, m, s in zip(w, row, mean, scale)) + w[-1] for row in rows])


def plain_cotrain(views, y, pool):
    """Rounds, calibration and combination with plain lists."""
    sure = lambda t: 1 / (1 + np.exp(-t))
    held = [k for k in range(len(y)) if k % 3 == 0]
    own = [[(views[v][k], y[k]) for k in range(len(y)) if k % 3] for v in (0, 1)]
    fit = lambda rows: plain_fit(np.array([r for r, _ in rows]), np.array([t for _, t in rows]))
    left = set(range(len(pool[0])))
    for _ in range(op.ROUNDS):
        models, before = [fit(o) for o in own], len(left)
        for v in (0, 1):
            p = sure(models[v](pool[v]))
            for label, belief in ((1, p), (0, 1 - p)):
                best = sorted((k for k in left if belief[k] >= op.SURE), key=lambda k: (-belief[k], k))[: op.GROWTH]
                left -= set(best)
                own[1 - v] += [(pool[1 - v][k], label) for k in best]
        if len(left) == before:
            break
    models = [fit(o) for o in own]
    raw = [models[v](views[v][held])[:, None] for v in (0, 1)]
    scales = [plain_fit(r, y[held]) for r in raw]
    last = plain_fit(np.stack([s(r) for s, r in zip(scales, raw)], 1), y[held])
    return lambda v: sure(last(np.stack([s(m(x)[:, None]) for s, m, x in zip(scales, models, v)], 1)))


def test_rounds_and_calibration_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(op, "GROWTH", 9)
    monkeypatch.setattr(op, "ROUNDS", 2)
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 130).astype(float)
    views = tuple(np.c_[y * 2.2 + rng.normal(0, 0.8, 130), rng.normal(0, 1, 130)] for _ in range(2))
    known, pool = tuple(v[:60] for v in views), tuple(v[60:] for v in views)
    got = op.cotrain(known, y[:60], pool).score(pool)[2]
    assert np.abs(got - plain_cotrain(known, y[:60], pool)(pool)).max() < 1e-4
    assert got.min() < 0.2 and got.max() > 0.8


def test_content_view_equals_counting_by_hand():
    texts = ["", "ab", "the the cat, the end.\n\n12 | x", "é1é1 A--B", "x" * 50]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    view = op.content_view(flat, np.r_[0, np.cumsum([len(t.encode()) for t in texts])])
    for text, row in zip(texts, view):
        raw, words = text.encode(), text.encode().split()
        pairs = np.zeros((op.KINDS, op.KINDS))
        for a, b in zip(raw, raw[1:]):
            pairs[op.CLASSES[a], op.CLASSES[b]] += 1
        most = max(len(words), 1)
        tail = [sum(a == b for a, b in zip(words, words[1:])) / most, len(set(words)) / most**0.7, np.log1p(len(raw) / most)]
        expected = np.r_[np.sqrt(pairs.ravel() / max(pairs.sum(), 1)), tail]
        assert np.abs(row - expected).max() < 1e-5
