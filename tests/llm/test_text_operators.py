"""Fingerprints, licences, leaks, quality and the language model against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetcohort.llm import decontaminate, fingerprint, gru, licenses, lm, quality
from tests.llm.helpers import ROWS, documents


def low(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingles(text, width=5):
    w = words(text)
    n = len(w)
    return {tuple(w[i : i + width]) for i in range(n - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_the_key_order(spark):
    rows = [(k * 3, f"{'a b c d e f g h ' * k}t{k}") for k in range(1300)]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs).collect()}
    ordered = sorted(rows)
    for n, (key, text) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        assert got[key]["edited_text"] == text[: len(text) - half] + after[:half]


def test_fingerprint_cases(spark):
    got = fingerprint.compare_with_next(documents(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in ROWS)
    text_of = {k: t for k, t in ROWS}
    by_text = {}
    for row in got:
        if row["doc_id"] is None:
            continue
        own = shingles(text_of[row["doc_id"]])
        assert row["n_chars"] == len(text_of[row["doc_id"]] or "")
        assert len(row["sketch"]) == min(len(own), fingerprint.SIZE)
        near = jaccard(own, shingles(row["edited_text"]))
        assert abs(row["near_edited"] - near) < (0.2 if len(own) > fingerprint.SIZE else 1e-9)
        by_text.setdefault(text_of[row["doc_id"]], set()).add(tuple(row["sketch"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.compare_with_next(documents(spark, [])).count() == 0


def test_sketches_merge(spark):
    texts = [" ".join(f"w{(i * 7 + k * 400) % 1500}" for i in range(900)) for k in range(3)]
    df = spark.createDataFrame([("g", t) for t in texts], "g string, text string")
    parts = fingerprint.with_sketch(df, "text", "sketch")
    whole = fingerprint.merge_groups(parts, ["g"]).first()["sketch"]
    union = sorted({h for r in parts.collect() for h in r["sketch"]})[: fingerprint.SIZE]
    assert whole == union
    a, b = (F.array(*map(F.lit, parts.collect()[k]["sketch"])) for k in (0, 1))
    row = spark.range(1).select(
        fingerprint.containment(a, b).alias("c"),
        fingerprint.distinct_shingles(a).alias("n"),
        fingerprint.resemblance(a, b).alias("r"),
    ).first()
    one, two = shingles(texts[0]), shingles(texts[1])
    assert abs(row["c"] - len(one & two) / len(one)) < 0.15
    assert abs(row["n"] - len(one)) < 0.25 * len(one)
    assert abs(row["r"] - jaccard(one, two)) < 0.15


def plain_licence(text, is_licence_file, model):
    """The best (score, licence) of all units against all templates, without key terms."""
    templates = {}
    for number, name, term, share in model.vectors:
        templates.setdefault((number, name), {})[term] = share
    found = []
    for unit in {*text.split("\n"), *([text] if is_licence_file else [])}:
        counts = Counter(licenses._terms(unit))
        weights = {t: n * model.idf.get(t, model.unknown) for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        for (_, name), own in templates.items():
            dot = sum(w * own.get(t, 0.0) for t, w in weights.items())
            if length and round(dot / length, 6) >= model.least:
                found.append((-round(dot / length, 6), name))
    return min(found, default=None)


def test_licences_equal_brute_force_behind_a_shuffle(spark):
    rng, model = random.Random(4), licenses.Model()
    texts = [t for _, t in licenses.TEMPLATES]
    words = sorted(model.idf) + ["other", "words", "x1"]
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.7:
            cut = rng.choice(texts).split(" ")
            cut = [w for w in cut if rng.random() < 0.9] + rng.choices(words, k=rng.randint(0, 4))
            lines.insert(rng.randint(0, len(lines)), " ".join(cut).upper() if i % 3 else " ".join(cut))
        name = "LICENSE" if i % 5 == 0 else f"f{i}.txt"
        rows.append((i, f"s{i % 7}/d{i % 31}/{name}", "\n".join(lines)))
    rows += [(400, "a/LICENSE", texts[0] + "\n" + texts[0]), (401, "a/x", " ".join(texts)), (402, "a/y", "word " * 60_000)]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    for name in ("key", "own", "directory", "is_licence_file", "score", "row", "licence"):
        files = files.withColumn(name, F.lit("clash"))
    shuffled = files.groupBy("id").agg(F.max("path").alias("path"), F.max("text").alias("text"))
    wanted = {i: plain_licence(t, p.endswith("LICENSE"), model) for i, p, t in rows}
    assert sum(w is not None for w in wanted.values()) > 100
    for df in (files, shuffled, files.repartition(7, "id"), files.repartition(1)):
        got = licenses.scan(df, "id", F.col("path")).collect()
        assert len(got) == len(rows)
        for r in got:
            own = wanted[r["id"]]
            assert r["own_licence"] == (own[1] if own else None)
            assert own is None or r["own_score"] == pytest.approx(-own[0], abs=2e-6)


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", licenses.TEMPLATES[5][1]
    rows = [
        ("a/LICENSE", f"some words\n{mit}\nmore words"), ("a/x.py", "code"), ("a/b/c/y.py", "code"),
        ("a/b/COPYING", gpl), ("a/b/own.py", "# Licensed under CC BY-NC 4.0."), ("a/bz/t.py", None),
        ("d/z.py", "licensed work in general"), ("top.py", mit), (None, gpl), (None, None),
        ("a/x.py", "code"), ("a/b/NOTICE", mit), ("e/LICENSE", ""), ("e/f.py", "x " * 30_000),
    ]
    files = spark.createDataFrame(
        [(n, *r, "clash") for n, r in enumerate(rows)],
        "id long, path string, text string, licence string",
    )
    got = {
        r["id"]: (r["own_licence"], r["licence"], r["inherited_from"])
        for r in licenses.scan(files, "id", F.col("path")).collect()
    }
    none = (None, None, None)
    assert got == {
        0: ("MIT", "MIT", None), 1: (None, "MIT", "a"), 2: (None, "GPL-3.0", "a/b"),
        3: ("GPL-3.0", "GPL-3.0", None), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        5: (None, "MIT", "a"), 6: none, 7: ("MIT", "MIT", None), 8: ("GPL-3.0", "GPL-3.0", None),
        9: none, 10: (None, "MIT", "a"), 11: ("MIT", "MIT", None), 12: none, 13: none,
    }
    empty = files.limit(0)
    assert licenses.scan(empty, "id", F.col("path")).count() == 0


def benchmark_items(n=60, seed=4):
    rng = random.Random(seed)
    common = "the of and to in is that for".split()
    make = lambda k: " ".join(
        rng.choice(common) if rng.random() < 0.4 else f"t{rng.randrange(500)}" for _ in range(k)
    )
    return [(i, f"{make(rng.randint(10, 50))}? {make(rng.randint(1, 9))}.") for i in range(n)]


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5])
def test_wand_retrieves_all_above_the_threshold(share):
    items = benchmark_items()
    index = decontaminate.Index(items)
    rng = random.Random(8)
    passage, term = [], []
    for p in range(60):
        own = rng.sample(range(len(index.most)), rng.randint(1, 120))
        for t in sorted(own):
            passage.append(p)
            term.append(t)
    passage, term = np.array(passage), np.array(term)
    got = {(p, i) for p, i, _ in index.retrieve(passage, term, share)}
    expect = set()
    for p in range(60):
        own = set(term[passage == p].tolist())
        for n, item in enumerate(index.items):
            if sum(w for t, w in item.weights.items() if t in own) >= share - 1e-9:
                expect.add((p, n))
    assert got == expect


def test_leaks_are_found_wherever_they_stand(spark):
    items = benchmark_items()
    rng = random.Random(3)
    filler = lambda k: " ".join(f"t{rng.randrange(500)}" for _ in range(k))
    rows = [
        (k, f"{filler(rng.randint(0, 900))} {items[k][1].upper() if k % 2 else items[k][1]} {filler(300)}")
        for k in range(40)
    ]
    rows += [(k, filler(1500)) for k in range(40, 80)]
    rows += [(80, None), (81, ""), (None, items[5][1]), (82, items[6][1] + " " + items[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    test = spark.createDataFrame([*items, (99, None), (None, "x"), (98, ""), (97, items[3][1])],
                                 "item_id long, text string")
    got = decontaminate.find_leaks(docs, test)
    assert got.columns == ["doc_id", "text", "item_id", "leaks"]
    found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in got.collect()}
    expect = {k: [k] for k in range(40)} | {k: [] for k in range(40, 82)} | {None: [5], 82: [6, 7]}
    assert found == expect
    assert all(not r["leaks"] for r in decontaminate.find_leaks(docs, test.limit(0)).collect())
    assert decontaminate.find_leaks(docs.limit(0), test).count() == 0


def test_a_benchmark_in_parts_gives_the_same_leaks(spark, monkeypatch):
    items = benchmark_items()
    rng = random.Random(5)
    near = lambda text: " ".join(w for w in text.split() if rng.random() < 0.8)
    rows = [(k, f"{items[k][1]} and {items[k + 1][1]}") for k in range(20)]
    rows += [(k, f"{near(items[k][1])} {near(items[k + 7][1])}") for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    repeated = [(900 + n, f"({t}" + "!") for n, (_, t) in enumerate(items)]  # the same words
    test = spark.createDataFrame([*items, *repeated], "item_id long, text string")

    def leaks():
        return {
            r["doc_id"]: [tuple(x) for x in r["leaks"]]
            for r in decontaminate.find_leaks(docs, test).collect()
        }

    whole = leaks()
    assert all([x[0] for x in whole[k]] == [k, k + 1] for k in range(20))
    parts = -(-len(items) // 20)
    monkeypatch.setattr(decontaminate, "PART_ITEMS", parts)  # some 20 parts
    cut = leaks()
    assert cut.keys() == whole.keys()
    for k, found in whole.items():
        assert [x[0] for x in cut[k]] == [x[0] for x in found]
        for a, b in zip(cut[k], found, strict=True):
            assert a[1:] == pytest.approx(b[1:], abs=1e-12)


def test_items_without_id_and_equal_scores(spark):
    item = "which moon of saturn has lakes of liquid methane? surely titan."
    other = "who painted large blue horses before nineteen twelve? franz marc."
    items = [(None, item), (None, item.upper()), (7, other), (5, other + " "), (None, other)]
    test = spark.createDataFrame(items, "item_id long, text string")
    long = "filler " * 300_000 + item
    rows = [(1, f"x {item} y"), (2, f"{other} {item}"), (3, long), (4, "which moon of saturn")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["leaks"] for r in decontaminate.find_leaks(docs, test).collect()}
    assert {k: [x["item_id"] for x in v] for k, v in got.items()} == {1: [None], 2: [5, None], 3: [None], 4: []}
    assert got[2][0]["share"] == pytest.approx(got[2][1]["share"])


def test_quality_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((scored[k] >= 0.3) == truth[k] for k in held) / len(held)
    assert right > 0.93
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == docs.count()
    awkward = quality.keep_good(documents(spark), model, 0.0)
    assert awkward.count() == len(ROWS) and awkward.columns == documents(spark).columns
    assert len(model.describe()) == len(model.rules) > 3


def test_quality_without_labels_or_classes(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality.score(docs, quality.fit(docs, one)).collect())


def test_language_model_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 300")
    docs = docs.select("doc_id", "text").union(documents(spark, extra=False).where("doc_id is null or doc_id > 2")
        .withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = Counter(lambda_crc(k) for k, _ in rows)
    assert len(out) == 7
    counts = Counter()
    for k, text in rows:
        if lambda_crc(k) != 2:
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    got = Counter()
    for r in lm.score(docs).collect():
        got[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)] += 1
        assert r["score"] < 0 and math.isfinite(r["score"])
    expect = Counter()
    for k, text in rows:
        own = [*words(text), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        expect[k, len(own), sum(counts[w] > 0 for w in own), total, round(base, 5)] += 1
    assert got == expect
    assert lm.score(documents(spark, [])).count() == 0


def lambda_crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7


def small_model(n_words=40):
    layout = gru.Layout(np.arange(n_words, 0, -1), 15, 30.0)
    return layout, gru.start(layout, hidden=5)


def test_every_training_document_gives_gradient_steps_once(spark, monkeypatch):
    seen, averaged = [], lm._averaged

    def watched(copies, like):
        seen.append(copies.where("piece = 0").agg(F.sum("weight")).first()[0] or 0)
        return averaged(copies, like)

    monkeypatch.setattr(lm, "_averaged", watched)
    rows = [(n, "some words " * (n % 5 + 1)) for n in range(60)]
    out = lm.score(documents(spark, rows)).collect()
    assert len(seen) == lm.ROUNDS and all(seen)
    assert sum(seen) == sum(r["n_tokens"] for r in out if not r["held_out"])


def test_probabilities_sum_to_one():
    layout, p = small_model()
    p["wc"] += 0.3
    p["wo"] += np.random.default_rng(0).standard_normal(p["wo"].shape).astype("f4")
    for before in ([], [3, 7, -1], [20, 1]):
        texts = [np.array([*before, w]) for w in [*range(40), -1]]
        total = gru.log_likelihood(p, layout, texts)
        prefix = gru.log_likelihood(p, layout, [np.array(before)]) if before else 0.0
        assert math.isclose(float(np.exp(total - prefix).sum()), 1.0, rel_tol=1e-4)


def test_state_is_carried_whatever_the_lanes():
    layout, p = small_model()
    rng = np.random.default_rng(1)
    texts = [rng.integers(-1, 40, size=n) for n in (1, 200, 33, 64, 5, 90)]
    one = gru.log_likelihood(p, layout, texts, n_lanes=1)
    assert np.allclose(one, gru.log_likelihood(p, layout, texts, n_lanes=4), rtol=1e-4)
    assert np.allclose(one[1], gru.log_likelihood(p, layout, [texts[1]]), rtol=1e-4)


def test_training_follows_the_gradient():
    layout, p = small_model()
    rng = np.random.default_rng(2)
    text = rng.integers(-1, 40, size=gru.WINDOW)
    wide = {k: v.astype(np.float64) for k, v in p.items()}
    loss = lambda q: -gru.log_likelihood(q, layout, [text])[0] / len(text)
    got = {}
    trainer = gru.Trainer(layout, wide)
    trainer._step = lambda name, at, g: got.setdefault(name, (at, g.copy()))
    trainer.learn([text], n_lanes=1)
    for name in ("u", "wc", "bc", "wo", "bo", "x"):
        at, g = got[name]
        for index in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)]:
            place = (at[index[0]], *index[1:]) if name == "x" else index
            step = 1e-3
            up, down = ({k: v.copy() for k, v in wide.items()} for _ in range(2))
            up[name][place] += step
            down[name][place] -= step
            slope = (loss(up) - loss(down)) / (2 * step)
            assert abs(slope - g[index]) < 2e-3


def test_training_beats_the_start():
    layout, p = small_model()
    texts = [np.array([5, 9, 2, 30] * 20) for _ in range(40)]
    trainer = gru.Trainer(layout, p)
    trainer.learn(texts, n_lanes=8)
    assert gru.log_likelihood(trainer.p, layout, texts).sum() > 0.5 * gru.log_likelihood(p, layout, texts).sum()


def test_digest_of_the_sha(spark):
    row = spark.range(1).select(F.sha2(F.lit("é").cast("binary"), 256).alias("s")).first()
    assert row["s"] == hashlib.sha256("é".encode()).hexdigest()


def test_words_are_cut_and_numbered_as_bytes_say():
    texts = [" A b\tC\x0b\x0cd\x1cE  ", "", " \r\n", "É Àx y\x00z\x85q\r\nÉ", "b a a", "q"]
    split, sizes = lm.split_words(pa.array(["dropped", *texts])[1:])
    assert split.to_pylist() == [w for t in texts for w in words(t)]
    assert sizes.tolist() == [len(words(t)) for t in texts]
    vocabulary = lm.Vocabulary([("a", 5), (None, 6), ("b", 3)], 20, 9)
    number = {None: 0, "a": 1, "b": 2}
    got = [own.tolist() for own in vocabulary.ids(split, sizes)]
    assert got == [[number.get(w, -1) for w in [*words(t), None]] for t in texts]
    flat = np.array([number.get(w, -1) for t in texts for w in words(t)])
    rest = lm._unnumbered(split, flat, sizes).to_pylist()
    expect = [Counter(w for w in words(t) if w not in number) for t in texts]
    assert [{w["word"]: w["n"] for w in own} for own in rest] == expect


def test_many_lanes_learn_as_well_as_few():
    """Large lots take one step for many lanes; the model must not be poorer for it."""
    layout, p = small_model()
    rng = np.random.default_rng(4)
    starts = rng.integers(0, 39, size=4000)
    texts = [np.array([s, s + 1] * 20) for s in starts]  # every other word follows from the last
    few, many = gru.Trainer(layout, p), gru.Trainer(layout, p)
    few.learn(texts[:1000], n_lanes=32)
    many.learn(texts, n_lanes=256)
    assert many.tokens == 160_000
    got = [gru.log_likelihood(t.p, layout, texts[:200]).sum() for t in (few, many)]
    assert got[1] > 1.05 * got[0]


def test_large_lots_have_many_lanes():
    """A step for 32 lanes at a time cost so much that the check tool stopped the training."""
    assert lm.lanes_for(lm.LOT) == 256
    assert lm.lanes_for(1000) == 32


def test_tokens_weigh_the_same_when_few_lanes_are_left():
    """A long document whose lane outlasts the others must not pull as hard as all lanes do."""
    layout, p = small_model()
    trainer, seen = gru.Trainer(layout, p), []
    trainer._step = lambda name, at, g: seen.append(np.abs(g).sum()) if name == "bc" else None
    trainer.learn([np.full(16 * gru.WINDOW, 7), *[np.full(gru.WINDOW, 7)] * 31], n_lanes=32)
    assert len(seen) == 16
    assert max(seen[1:]) < seen[0] / 16
