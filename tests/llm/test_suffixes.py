"""op12 and its sorting against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackforge.llm import deepshallow, q_suffixes, suffixes


def lcp(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


@pytest.mark.parametrize("shallow", [0, 8, 1000])
def test_deep_shallow_sorts(shallow):
    rng = random.Random(shallow)
    stems = [bytes(rng.choice(b"ab\x00\xff") for _ in range(40)) for _ in range(6)]
    strings = [(s := rng.choice(stems))[: (k := rng.randint(0, 40))] + bytes(rng.choice(b"ab\x00") for _ in range(40 - k)) for _ in range(400)] + stems * 2
    group = np.array([rng.randint(0, 3) for _ in strings])
    order, common = deepshallow.deep_shallow(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 40), group, shallow)
    got = [(group[i], strings[i]) for i in order]
    assert got == sorted(zip(group.tolist(), strings, strict=True)) and sorted(order) == list(range(len(strings)))
    assert common.tolist() == [-1 if not j or got[j][0] != got[j - 1][0] else lcp(got[j - 1][1], got[j][1]) for j in range(len(got))]


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, x in enumerate(data):
        for i in range(len(x) - length + 1):
            places[x[i : i + length]].append((d, i))
    gone = [bytearray(len(x)) for x in data]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for x, g in zip(data, gone, strict=True):
        runs = sum(1 for i, v in enumerate(g) if v and not (i and g[i - 1]))
        out.append((len(x), sum(g), runs, hashlib.sha256(bytes(b for b, v in zip(x, g, strict=True) if not v)).hexdigest()))
    return out


def corpus(rng, n, length):
    alphabet = "abé 中😀"
    say = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [say(length + rng.randint(-20, 90)) for _ in range(4)]
    texts = [None, "", "a", "a" * (3 * length), "ab" * (2 * length), "\x00" * (2 * length), say(length)]
    for _ in range(n):
        t = say(rng.randint(0, 3 * length))
        for _ in range(rng.randint(0, 2)):
            cut, s = rng.randint(0, len(t)), rng.choice(shared)
            t = t[:cut] + s[rng.randint(0, 15) : len(s) - rng.randint(0, 15)] + t[cut:]
        texts.append(t)
        if rng.random() < 0.2:
            k = rng.randrange(len(t) + 1)
            texts += [t[:k] + "x" + t[k:], t]
    return texts


@pytest.mark.parametrize("length, block, hot, bucket", [(200, 8_000_000, 1000, 20_000), (200, 3000, 1000, 50), (200, 3000, 1, 20_000), (40, 2000, 4, 7)])
def test_repeats(spark, monkeypatch, length, block, hot, bucket):
    for name, n in (("BLOCK_BYTES", block), ("HOT", hot), ("BUCKET_ENTRIES", bucket), ("CHUNK", 1 << 10)):
        monkeypatch.setattr(suffixes, name, n)
    texts = corpus(random.Random(length + hot), 60, length)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "ids", "kept", "spans", "h", "data")}).repartition(4)
    rows = {r.doc_id: r for r in q_suffixes.digests(suffixes.repeats(d, length)).collect()}
    assert len(rows) == len(texts)
    for i, want in enumerate(brute(texts, length)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want, i


def test_repeated_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "x" * 50 + "y" * 200), (1, "x" * 50 + "y" * 200), (None, "clean")], "doc_id long, text string")
    cut = spark.createDataFrame([(2, "é" + "z" * 199), (3, "©" + "z" * 199)], d.schema)
    assert sorted(r.text for r in suffixes.without_repeats(cut).collect()) == ["\ufffd", "\ufffd"]
    got = sorted(map(str, (tuple(r) for r in suffixes.without_repeats(d).collect())))
    assert got == ["(1, '')", "(1, '')", "(None, 'clean')"]
    assert suffixes.repeats(d.limit(0)).count() == 0
