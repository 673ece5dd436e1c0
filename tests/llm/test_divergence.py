"""op13 against plain arithmetic, on small tables with nulls, ties, repeats, long texts and clashing names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackforge.llm import divergence

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def brute(rows, least, top=10):
    f = lambda p, q: (p - q) ** 2 // (p + q)
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    words = lambda t: re.findall(LETTERS, re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {r[1] for r in rows}:
        df, every, own = Counter(), Counter(), {}
        for t, a, b in rows:
            if a == lang:
                df.update(set(words(t)))
                own.setdefault(b, Counter()).update(words(t))
        kept = {t for t, n in df.items() if n >= least}
        for c in own.values():
            every.update({t: n for t, n in c.items() if t in kept})
        v, shares = len(kept), {}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        shares = {b: share(c) for b, c in own.items()}
        q = share(every)
        for b, p in shares.items():
            pair = [(-sum(f(p[t], shares[o][t]) for t in kept), o.encode()) for o in own if o != b]
            term = [(-f(p[t], q[t]), t.encode()) for t in kept if own[b][t] and p[t] > q[t]]
            out += [(lang, b, kind, item.decode(), -n, i) for kind, values in (("pair", sorted(pair)), ("term", sorted(term)[:top])) for i, (n, item) in enumerate(values, 1)]
    return sorted(out)


@pytest.mark.parametrize("tight", [False, True])
def test_divergence(spark, monkeypatch, tight):
    if tight:  # many flushes, pieces, buckets, and no broadcast
        for name, n in (("HELD", 5), ("PIECE", 7), ("BUCKET_POSTINGS", 3), ("BROADCAST_GROUPS", 0)):
            monkeypatch.setattr(divergence, name, n)
    rng = random.Random(13)
    pool = ["ab", "Ab", "é", "É", "zz", "q", "中文", "it's", "x1y", "lang", "😀", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choice(pool[i % 3 :]) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "S1", "é", None, "", "z"])) for i in range(200)]
    rows += [("", "xx", "only"), (None, "xx", "two"), ("alone", "yy", "one"), ("rare", "en", "new"), (" ab" * 40_000, "en", "s1"), *rows[:20]]
    d = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, p int").withColumn("n", F.lit(3)).repartition(5)
    got = sorted(map(tuple, divergence.audit(d, least_docs=4).collect()))
    assert got == brute(rows, 4) and {r[2] for r in got} == {"pair", "term"}
    assert not divergence.audit(d.limit(0)).count()
