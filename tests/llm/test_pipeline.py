"""The five stages, on documents whose fate is known."""

import os
import random
import re
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from test_llm import PLAIN, VOC, brute_groups, brute_hits, luhn

import corpus_pipeline as pipeline
from trackforge.llm.common import scope, shared_dir
from trackforge.llm.epsilon_grid import near_vectors

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    one = docs.where("length(text) > 800").orderBy("doc_id").first()
    extra = [
        (900_001, one.text, one.lang, "s", 1), (900_002, one.text + " tail", one.lang, "s", 1), (900_003, "clean words before. " + item, "en", "s", 1),
        (900_004, None, "en", "s", 0), (900_005, "123 !!", "en", "s", 1), (900_006, "write to jane.roe@mail9.example.com about the thing", "en", "s", 1)]
    d = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, d, SF)
        if i < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in d.select("doc_id").collect()}
    assert {900_004, 900_005} & kept["language"] == set() and {900_001, 900_003, 900_006} <= kept["language"]
    assert {900_001, 900_002} & kept["near_duplicates"] == set() and one.doc_id in kept["near_duplicates"]
    assert 900_003 in kept["near_duplicates"] and 900_003 not in kept["decontaminate"]
    assert kept["decontaminate"] == kept["personal_data"] == kept["tokens"]
    texts = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "personal_data")).collect()}
    assert "[EMAIL]" in texts[900_006].text and "jane.roe" not in texts[900_006].text
    assert all(r.decoded == texts[r.doc_id].text and len(r.ids) == r.n_tokens for r in d.collect())
    assert len(kept["tokens"]) > 0.7 * docs.count()
    assert pipeline.ORACLE_SQL is None


def ranked(texts, size=400):
    counts = {}
    for t in texts:
        padded = " " + " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())) + " "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip() and " " not in g[1:-1]:
                    counts[g] = counts.get(g, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]


def known_language(rows):
    """Rows of (id, text, lang) that stay."""
    learnt = [r for r in rows if r[1] is not None and r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)]
    profiles = {lang: {g: i for i, g in enumerate(ranked([r[1] for r in learnt if r[2] == lang]))} for lang in {r[2] for r in learnt}}

    def score(text):
        own = ranked([text])
        far = [sum(abs(i - p[g]) if g in p else 400 for i, g in enumerate(own)) / (len(own) * 400) for p in profiles.values()] if own else [1]
        return 1 - min(far)

    return [r for r in rows if score(r[1]) >= pipeline.LEAST_SCORE]


def base_spans(text):
    out = []
    for kind, (_, p) in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 13 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][kind]:
                out.append((m.start(), m.end(), kind, (kind, d if kind > 1 else m[0].lower())))
    return out


def without_personal_data(rows):
    spans = {r: base_spans(r[1]) for r in rows}
    holders, terms = {}, {r: {w.lower() for w in regex.findall(r"\p{L}+", r[1])} for r in rows}
    for r, found in spans.items():
        for s in found:
            holders.setdefault(s[3], set()).add(r)
    count = {}
    for r in rows:
        for t in terms[r]:
            count[t] = count.get(t, 0) + 1
    gone = {r: set() for r in rows}
    for held in holders.values():
        if len({r[1] for r in held}) >= 3:
            for t in set().union(*(terms[r] for r in held)):
                near = [r for r in held if t in terms[r]]
                if len(near) >= count[t] / 2 and len({regex.sub(r"\P{L}+", " ", r[1]).lower() for r in near}) >= 3:
                    for r in near:
                        gone[r].add(t)
    out = []
    for r in rows:
        every = [(a, b, kind) for a, b, kind, _ in spans[r]] + [(m.start(), m.end(), 4) for m in regex.finditer(r"\p{L}+", r[1]) if m[0].lower() in gone[r] and not any(a <= m.start() and m.end() <= b for a, b, *_ in spans[r])]
        text, at = "", 0
        for a, b, kind in sorted(every):
            if b > at:
                text += r[1][at : max(a, at)] + "[" + ["EMAIL", "IP", "CARD", "PHONE", "TERM"][kind] + "]"
                at = b
        out.append((r[0], text + r[1][at:]))
    return out


def test_rows_are_those_of_brute_force(spark):
    rng = random.Random(21)
    parts = {"en": ["the", "ing", "er", "on", "and", "th"], "de": ["sch", "ung", "ein", "der", "ich", "st"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, say("en", 14)) for i in range(3)]
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        text = say(lang, rng.randint(4, 90))
        if i % 9 == 0:
            text += " " + items[i % 3][1]
        if i % 6 == 1:
            text += f" Zorblax {i} jo.doe@x{i % 2}.org, 10.0.0.{i % 3} and 4111 1111 1111 1111 / +49 (30) 1234-5678"
        rows.append((i, text, lang))
        if i % 4 == 0:
            for k in range(rng.randint(1, 3)):
                w = text.split()
                w[rng.randrange(len(w))] = "changed"
                rows.append((1000 + 10 * i + k, " ".join(w), lang))
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "12 34 !", "de"), (2003, "\u4e2d\u6587 \u6587\u5b57", None), (None, say("en", 40), "en"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]

    left = known_language(rows)
    groups, best = brute_groups([r[1] for r in left], 5), {}
    for (_, g), r in zip(groups, left, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    left = [r for r in best.values() if not brute_hits(r[1], items, 10)[1]]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOC.ranks, special_tokens={})
    want = sorted((str(i), text, enc.encode_ordinary(text)) for i, text in without_personal_data(left))
    assert 40 < len(want) < len(rows) - 20 and any("[TERM]" in x[1] for x in want) and any("[CARD]" in x[1] for x in want)

    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, said int")
    for name in ("lang_pred", "_spans", "gone", "seen", "low", "n", "cls", "hit_doc"):
        d = d.withColumn(name, F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    old, pipeline.table = pipeline.table, lambda *a: bench
    try:
        columns = d.columns
        for name, stage in pipeline.STAGES:
            d = stage(spark, d, "nowhere")
            assert name == "tokens" or d.columns == columns
        got = sorted((str(r.doc_id), r.decoded, r.ids) for r in d.collect())
        empty = spark.createDataFrame([], "doc_id long, text string, lang string")
        for _, stage in pipeline.STAGES:
            empty = stage(spark, empty, "nowhere")
        assert empty.count() == 0
    finally:
        pipeline.table = old
    assert got == want


def test_scopes_own_their_tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with scope():
        vectors = near_vectors(spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)], "vec_id long, embedding array<float>"))
        with scope():
            assert pipeline.run(spark, SF).count()
        assert vectors.count() == 30
    assert set(folder.iterdir()) == before
