"""The training-data operators against brute force, on small tables with nulls, ties, repeats, empty and long
texts, and columns whose names clash with the operators' own."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trackforge.llm import chat, decontam, epsilon_grid, hmm, langid, licenses, minhash, pii, q_bpe, q_chat, q_decontam, q_licenses, q_urls, urls, wordblocks
from trackforge.llm.bpe import Vocabulary
from trackforge.llm.common import Scratch
from trackforge.llm.components import connected

DOCS = "doc_id long, text string, _text string, n int, words int, start int, cls int, kind int"
VOC = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in enumerate(texts, first)], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ODD = [None, "", " \n\t", "a", "Ünïcode É word", "!!! ???", "x" * 5000, "word " * 3000, "\x00\x1c control", "😀 emoji 😀"]


# op1


def brute_hits(text, items, n):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(n, len(x))
        wins = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
        for i in range(len(w) - k + 1) if wins else ():
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(1, say(12)), (2, "b c"), (10, None), (11, "..."), (12, say(6)), (2, "b c")]
    texts = ODD + [say(rng.randint(1, 60)) for _ in range(60)] + [items[0][1] + "! " + items[4][1].upper()]
    d = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_hits(d, bench, n=5).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items, 5)
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"], rows[i].contaminated) == (n, hit, found, hit > 0)
        assert rows[i].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert sum(s.end - s.start for s in rows[i].spans) == hit
    clean = decontam.decontaminate(d, bench, n=5)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, r in rows.items() if not r.contaminated}
    more = {c: F.lit(1) for c in ("hit_spans", "_hit_spans", "words", "gaps", "hit_doc")}
    cut = decontam.decontaminate(d.drop("words").withColumns(more), bench, n=5, mode="span")
    assert cut.count() == len(texts) and set(more) <= set(cut.columns)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert all(kept[i] == t for i, t in enumerate(texts) if not rows[i].contaminated)
    assert all(len(words(kept[i])) == rows[i].n_words - rows[i].n_hit for i in rows if rows[i].contaminated)
    exact = decontam.decontaminate(docs(spark, ["x, b C? y b c. b c! z", "b c", "q b c"]), spark.createDataFrame([(1, "b c")], "item_id long, text string"), mode="span")
    assert [r.text for r in exact.orderBy("doc_id").collect()] == ["x, ? y ! z", "", "q "]
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.find_hits(d, none).collect())
    assert decontam.find_hits(d.limit(0), bench).count() == 0
    plan = decontam.find_hits(d, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_repeats(spark):
    d = docs(spark, ["b c", "b c"]).withColumn("doc_id", F.lit(7).cast("long")).unionByName(docs(spark, ["d"]).withColumn("doc_id", F.lit(None).cast("long")))
    out = decontam.find_hits(d, spark.createDataFrame([(1, "b c")], "item_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_hit) for r in out) == [(False, 2, 2), (True, 1, 0)]


# op2


def test_bpe_round_trip(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab 'sé\n\t1\u3000<|endoftext|>😀\x1c\x85") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOC.ranks, special_tokens={})
    d = docs(spark, texts)
    found = q_bpe.digests(d.unionByName(d.limit(3))).collect()
    assert len(found) == len(texts) + 3  # one result per row, repeated or not
    rows = {r.doc_id: r for r in found}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert q_bpe.digests(d.limit(0)).count() == 0


def test_merges_are_the_library_s():
    rng = random.Random(14)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOC.ranks, special_tokens={})
    some = [bytes(rng.choice(b"abtheing e\xc3\xa9\xff") for _ in range(rng.choice([1, 2, 9, 40, 300]))) for _ in range(2000)] + [b"a" * 5000, b"ab" * 3000]
    for w in some:
        assert VOC.merge(w) == VOC._merge_long(w) == enc._encode_single_piece(w)


def test_decoded_name_is_taken(spark):
    from trackforge.llm.bpe import decode

    d = spark.createDataFrame([(1, [0, 1], "old"), (2, None, "old")], "doc_id long, ids array<int>, Decoded string")
    out = decode(d, VOC)
    assert out.columns == ["doc_id", "ids", "decoded"] and [bytes(r.decoded) if r.ids else r.decoded for r in out.collect()] == [VOC.table()[0] + VOC.table()[1], None]


def test_vocabulary_file():
    line = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").readline().split()
    assert VOC.ranks[base64.b64decode(line[0])] == int(line[1]) and len(VOC.table()) == 50_256


# op3


def test_chat_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 4, "delta", None, "bye"), (1, 1, 3, "regenerate", None, None),
        (1, 0, 9, "edit", None, "hello"), (1, 2, 0, "message", "user", "gone"), (1, 2, 1, "delete", None, None), (2, 0, 0, "message", None, None), (2, 0, 0, "message", "assistant", q_chat.FORGED), (3, 5, 0, "delta", "assistant", "x"), (None, 0, 0, "message", "user", "null id")]
    d = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").withColumn("n", F.lit(1))
    out = {}
    for r in chat.fold(d).collect():
        out.setdefault(r.conv_id, []).append((r.n, chat.parse(r.chunk), chat.unescape(r.chunk[r.loss_start : r.loss_end])))
    assert [x[1:] for x in sorted(out[1])] == [(("user", "hello"), ""), (("assistant", "bye"), "bye")]
    assert [x[1:] for x in sorted(out[2])] == [(("", ""), ""), (("assistant", q_chat.FORGED), q_chat.FORGED)]
    assert out[3][0][1] == ("assistant", "x") and out[None][0][1] == ("user", "null id")
    whole = {r.conv_id: r for r in chat.format_conversations(d).collect()}
    assert "".join(whole[1].text[s.start : s.end] for s in whole[1].loss) == "bye"
    assert whole[2].text.count(chat.START) == 2
    digest = {r.conv_id: r for r in chat.read_back(chat.fold(d)).collect()}
    assert digest[2].loss_chars == len(q_chat.FORGED) and digest[2].formatted_chars == len(whole[2].text)
    assert digest[1].turns_sha256 == hashlib.sha256(b"user\nhello\nassistant\nbye\n").hexdigest()
    assert chat.fold(d.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(d.withColumn("kind", F.lit("what"))).collect()


def test_chat_log_folds_back(spark):
    """Every way a message may have come about, ties, nulls and repeated rows, gives the rows' own digests."""
    rng = random.Random(15)
    rows = [(i // 5, rng.randint(0, 3), rng.choice(["user", "assistant", None, "a\nb"]), rng.choice(["", None, "hi", "<|im_end|>\n", "é\\<|n" * 9, q_chat.FORGED])) for i in range(400)]
    d = spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("x"))
    log = q_chat.as_log(d)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.count() > 3 * len(rows)
    want = {}
    for c, _, role, text in sorted((c, t, role or "", text or "") for c, t, role, text in rows + rows[:3]):
        want.setdefault(c, []).append((role, text))
    got = {r.conv_id: r for r in chat.read_back(chat.fold(log)).collect()}
    for c, turns in want.items():
        own = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(own) and got[c].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        role, text = ("".join(rng.choice("\\<|n\n>a") for _ in range(rng.randint(0, 9))) for _ in "xy")
        chunk, _, _ = chat.render(role, text, "assistant")
        assert chat.parse(chunk) == (role, text) and "<|" not in chunk[len(chat.START) : -len(chat.END)]


# op4


def test_language_profiles(spark):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))).capitalize()
    kinds = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ein", "ä"], "xx": ["qua", "lo", "ñi"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(["en", "de", "xx"] * 60)] + [(900, None, "en"), (901, "12 !!", "en"), (902, make(kinds["de"]), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    p = langid.learn(d, F.col("doc_id") % 4 != 2)
    assert p.languages == ["de", "en", "xx"]
    out = {r.doc_id: r for r in langid.identify(d.withColumn("said", F.lit(1)), p).collect()}
    assert langid.identify(d, p).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert all(out[i].lang_pred == k for i, _, k in rows[:180] if i % 4 == 2)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0 and out[902].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(d.select("doc_id", "text").limit(0), p).count() == 0
    assert {r.lang_pred for r in langid.identify(d.select("text"), langid.learn(d.limit(0), F.lit(True))).collect()} == {"und"}


def test_language_counts_are_exact():
    t = langid._Text(["Ab, a!", "", "É b"])
    got = {}
    for n in (1, 2, 3):
        for d, c, k in zip(*(x.tolist() for x in langid._counted(*t.grams(n), len(t.alphabet) ** n))):
            got[d, t.name(c, n)] = k
    want = {}
    for d, text in enumerate(["ab, a!", "", "é b"]):
        padded = " " + " ".join(re.findall(r"[^\W\d_]+", text)) + " "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip() and " " not in g[1:-1] and (n > 1 or g != " "):
                    want[d, g] = want.get((d, g), 0) + 1
    assert got == want


def test_language_distances_are_exact():
    """Ranks by count, length, characters; out-of-place sums; against a plain version."""
    rng = random.Random(16)
    texts = ["", "a", "ab ba", "Zz zz", "e" * 3000] + ["".join(rng.choice("abcdé ,") for _ in range(rng.randint(1, 300))) for _ in range(60)]

    def ranked(text, size):
        counts = {}
        padded = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip() and " " not in g[1:-1]:
                    counts[g] = counts.get(g, 0) + 1
        return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]

    of = {"x": ranked("abba cab dab", 20), "y": ranked("éa éb ccc", 20)}
    grams = {}
    for k, lang in enumerate(of):
        for r, g in enumerate(of[lang]):
            grams.setdefault(g, []).append((k, r))
    got = langid._distances(langid._Text(texts), langid.Profiles(list(of), grams, 20, 3))
    for i, t in enumerate(texts):
        own = ranked(t, 20)
        for k, lang in enumerate(of):
            far = sum(abs(r - of[lang].index(g)) if g in of[lang] else 20 for r, g in enumerate(own))
            assert abs(got[i, k] - far / (max(1, len(own)) * 20)) < 1e-12


# op5


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(epsilon_grid, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    v = [(base[i % 12] + rng.normal(size=8) * 0.12).astype(np.float32).tolist() for i in range(150)]
    v += [v[0], [x * 2 for x in v[1]], [0.0] * 8, None, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 0.0], [2.0, 0.0]]
    v += [[x * f for x in v[i]] for i in (0, 1, 2, 30) for f in (1e-200, 1e200, 3.0)] + [[5e-324] * 8, [1e308] * 8, [1e308, 1e-308] * 4]
    v += [(base[3] + rng.normal(size=8) * 0.02).tolist() for _ in range(60)]  # a dense group over several blocks
    d = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, cls int, n int")
    ok = lambda x: bool(x) and all(y is not None and math.isfinite(y) for y in x) and any(x)
    small = lambda a: a / np.abs(a).max()
    cos = lambda a, b: np.dot(a := small(a), b := small(b)) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    link = {i: {j for j in range(len(v)) if j != i and ok(v[i]) and ok(v[j]) and len(v[i]) == len(v[j]) and cos(np.array(v[i], float), np.array(v[j], float)) >= 0.95} for i in range(len(v))}
    low = {i: i for i in link}
    while True:
        new = {i: min([low[i], *(low[j] for j in link[i])]) for i in link}
        if new == low:
            break
        low = new
    out = {r.vec_id: r for r in epsilon_grid.near_vectors(d).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {i: (len(link[i]), low[i], low[i] == i) for i in link}
    assert epsilon_grid.near_vectors(d.limit(0)).count() == 0


def test_embedding_repeats(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (2, None), (2, None)]
    out = epsilon_grid.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out)
    assert got == sorted([("1", 2, "1"), ("1", 2, "1"), ("1", 0, "1"), ("None", 2, "1"), ("None", 0, "None"), ("2", 0, "2"), ("2", 0, "2")])


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(e, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# op6


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "COM", "b.com", "b.c.com", ""]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in ("org", "example.org", "com", "c.com", "a.example.org") for p in ("/", "/a", "/a/b", "/é") if rng.random() < 0.7] + [("com", "/", "allow"), ("com", "/", "block")]
    pages = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c', '/ab', '/é1', '?q', '#f', '/a?x://y'])}" for _ in range(300)] + [None, "", "nothing", "a://", "://x", "x\n://org/a", "http://a.example.org:80/a", "ftp://u@b.com/"]
    merged = {}
    rules += [("b.com", "", "block"), ("", "/a", "block"), (None, "", "allow"), ("Org", "/ab", "block"), ("b.com", None, "allow")]
    pages += ["http://a.b.com", "http://b.com/x/" + "y" * 100_000, "http://b.com./a", "http://" + "a." * 100_000 + "example.org/a"] + [pages[0]] * 30 + [None] * 5
    d = spark.createDataFrame([(i, u, 0) for i, u in enumerate(pages)] + [(None, "http://x.org/a", 0)] * 2, "page_id long, url string, key int")
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        merged[h, p] = max(v, merged.get((h, p), ""))
    found = urls.judge(d, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(found) == len(pages) + 2
    out = {r.page_id: r for r in found}
    assert out[None].host == "x.org"
    for i, u in enumerate(pages):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for (h, p), v in merged.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow")) if fit else (0, None, "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, best[1], best[2]), u
    assert urls.judge(d.limit(0), spark.createDataFrame(q_urls.RULES, "host string, path string, verdict string")).count() == 0


# op7


def test_license_phrases(spark):
    rng = random.Random(7)
    grant = licenses.NOTICES[1].text
    bent = grant.replace("free of charge", "free of any charge").replace("merge, ", "")
    texts = ODD + [" ".join(rng.choice(["mit", "license", "MIT", "apache", "general", "public", "x"]) for _ in range(rng.randint(1, 40))) for _ in range(80)] + ["Intro. " + grant, bent, " ".join(grant.split()[:12])]
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in licenses.scan(d).collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, t in enumerate(texts):
        w = words(t)
        want = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
        got = [s for s in rows[i].spans if s.exact]
        assert rows[i].n_words == len(w) and sorted((s.start, s.label) for s in got) == want
        assert all(s.end - s.start == len([p for p, label in phrases.items() if label == s.label][0]) for s in got)
    full, part, short = (rows[len(texts) - k].spans for k in (3, 2, 1))
    assert [(s.label, s.start) for s in full] == [("mit", 1)] and full[0].covered == 1.0
    assert [s.label for s in part] == ["mit"] and 0.7 <= part[0].covered < 1 and short == []
    assert licenses.scan(d.limit(0)).count() == 0
    assert set(q_licenses.op7_licenses.__annotations__) == {"spark", "sf_dir", "return"}


def brute_notices(w, template, k, gap, coverage):
    """(start, end, covered) of each diagonal of most votes within reach."""
    t = words(template)
    grams = len(t) - k + 1
    at = {}
    for i in range(grams):
        for p in range(len(w) - k + 1):
            if w[p : p + k] == t[i : i + k]:
                at.setdefault(p - i, set()).add(i)
    near = lambda d: [e for e in at if abs(e - d) <= gap]
    rank = {d: (-sum(len(at[e]) for e in near(d)), -len(at[d]), d) for d in at}
    out = []
    for d in at:
        if all(rank[d] <= rank[e] for e in near(d)):
            found = set().union(*(at[e] for e in near(d)))
            if len(found) / grams >= coverage:
                out.append((min(e + min(at[e]) for e in near(d)), max(e + max(at[e]) for e in near(d)) + k, round(len(found) / grams, 9)))
    return sorted(out)


def test_license_voting(spark):
    rng = random.Random(17)
    short = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    templates = (licenses.Template("t1", "x", short(30)), licenses.Template("t2", "y", short(12)), licenses.Template("t3", "x", licenses.NOTICES[0].text), licenses.Template("none", "z", "a b"))
    texts = list(ODD)
    for i in range(150):
        own = words(templates[i % 3].text)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 2)] = short(rng.randint(0, 12)).split()
        texts.append(" ".join(short(rng.randint(0, 9)).split() + own + (own if i % 5 == 0 else [])))
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in licenses.scan(d.unionByName(d.limit(20)), templates).collect()}
    assert len(rows) == len(texts)
    n = 0
    for i, t in enumerate(texts):
        for x in templates[:3]:
            want = brute_notices(words(t), x.text, 3, 8, 0.7)
            assert sorted((s.start, s.end, round(s.covered, 9)) for s in rows[i].spans if s.name == x.name) == want
            n += len(want)
    assert n > 50 and not any(s.name == "none" for r in rows.values() for s in r.spans)


def test_license_templates_beyond_the_broadcast(spark, monkeypatch):
    d = docs(spark, ["x " + licenses.NOTICES[3].text, "no license", None, "word other " * 20_000 + "mit license"])
    want = sorted(map(str, licenses.scan(d).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_POSITIONS", 0)
    assert sorted(map(str, licenses.scan(d).collect())) == want  # 40,000 positions with their whole text would be 16 GB


# op8


@pytest.mark.parametrize("chunk", [6, 1000])
def test_forward_and_backward_are_exact(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    monkeypatch.setattr(hmm, "LANES", 3)
    rng = np.random.default_rng(8)
    k, s = 3, 7
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k))
    lens = np.array([5, 1, 9, 2, 30, 1, 4])
    x = rng.integers(0, s, lens.sum()).astype(np.uint32)
    chain = hmm.Chain(m, x, lens)
    starts, moves, emits, logs = np.zeros(k), np.zeros((k, k)), np.zeros((k, s)), []
    for y in np.split(x, np.cumsum(lens)[:-1]):
        a, b = np.zeros((len(y), k)), np.ones((len(y), k))
        a[0] = m.start * m.emit[:, y[0]]
        for t in range(1, len(y)):
            a[t] = (a[t - 1] @ m.move) * m.emit[:, y[t]]
        for t in range(len(y) - 2, -1, -1):
            b[t] = m.move @ (m.emit[:, y[t + 1]] * b[t + 1])
        p = a[-1].sum()
        logs.append(math.log10(p))
        g = a * b / p
        starts += g[0]
        for t, z in enumerate(y):
            emits[:, z] += g[t]
            if t:
                moves += np.outer(a[t - 1], m.emit[:, z] * b[t]) * m.move / p
    got = chain.expected()
    assert np.allclose(chain.log10(), logs) and np.isclose(got[3], sum(logs))
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emits)


def test_language_model(spark):
    rng = random.Random(9)
    topics = [["sun", "sea", "sand"], ["tax", "law", "court"]]
    texts = ODD + [" ".join(rng.choice(topics[i % 2]) for _ in range(rng.randint(3, 40))) for i in range(120)]
    d = docs(spark, texts)
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    cfg = hmm.Config(states=2, rounds=8, least_gain=0)
    out = {r.doc_id: r for r in hmm.score(d, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, cfg=cfg).collect()}
    own = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
    counts = {}
    for i, ws in own.items():
        for w in ws if fold(i) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ws in own.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(ws), sum(w in counts for w in ws), n, fold(i) != 0)
        assert abs(r.base_score - sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
    held = [i for i in range(len(ODD), len(texts)) if fold(i) == 0]
    assert sum(out[i].score for i in held) > sum(out[i].base_score for i in held)
    assert hmm.score(d.limit(0), F.lit(True), cfg=cfg).count() == 0


def test_language_model_tells_rare_words_apart(spark):
    """More than 1,000 words with one ending and one count: only emissions of their own tell them apart."""
    rng = random.Random(11)
    names = [[f"{a}{i:04d}xyz" for i in range(700)] for a in "pq"]
    runs = [(k, [rng.choice(names[k]) for _ in range(30)]) for k in range(2) for _ in range(300)]
    rng.shuffle(runs)
    pure = [[names[k][i] for i in range(j, j + 40)] for k in range(2) for j in range(0, 400, 40)]
    mixed = [[w for p in zip(a[:20], b[20:], strict=True) for w in p] for a, b in zip(pure[:10], pure[10:], strict=True)] + [[w for p in zip(a[20:], b[:20], strict=True) for w in p] for a, b in zip(pure[:10], pure[10:], strict=True)]
    texts = [" ".join(w) for w in [r for _, r in runs] + pure + mixed]
    d = docs(spark, texts)
    out = {r.doc_id: r.score - r.base_score for r in hmm.score(d, F.col("doc_id") < len(runs), cfg=hmm.Config(states=2, rounds=25, least_gain=0)).collect()}
    a, b = len(runs), len(runs) + len(pure)
    assert sum(out[i] for i in range(a, b)) > sum(out[i] for i in range(b, len(texts))) + 20


# op9

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            out += [(kind, m.start(), m.end())] * ok
    return out


def test_pii_patterns(spark):
    rng = random.Random(10)
    pick = lambda a, n, m: "".join(rng.choice(a) for _ in range(rng.randint(n, m)))
    texts = ODD + [pick("ab.@@+--%  012345é(\n.", 0, 60) for _ in range(1500)] + [pick("4111 -0.+", 10, 40) for _ in range(1500)] + [pick(["1", "22", "255", "256", ".", ".", "a", " "], 1, 30) for _ in range(600)]
    texts += [a + c + b for c in ("4111111111111111", "4111 1111-1111 1111") for a in ("", "-", " ", "--", "x") for b in ("", "-", "- ", "y", " 2")]
    texts += ["1" * 20000, "a." * 5000 + "@b.c", "x@" + "a." * 20000 + "b", "1 " * 20000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] for r in pii.find(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    bad = [(t[:80], got[i][:3]) for i, t in enumerate(texts) if t and len(t) < 9000 and plain_spans(t) != got[i]]
    assert not bad, bad[:3]
    assert pii.find(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [pii.BROADCAST_BYTES, 0])
def test_pii_terms_of_repeated_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    d = docs(spark, ["Mail Zorblax now at a@b.cc ok", "then zorblax said a@b.cc fine", "Herr Zorblax, a@b.cc !", "nothing said here"]).withColumns({c: F.lit(1) for c in ("_spans", "own_spans", "own_doc", "doc", "seen", "_doc")})
    four = d.unionByName(d).unionByName(d).unionByName(d)
    once, often = pii.sanitise(d), pii.sanitise(four)
    assert once.columns == d.columns
    want = {r.doc_id: r.text for r in once.collect()}
    got = often.select("doc_id", "text").collect()
    assert "[TERM]" in want[0] and len(got) == 16 and all(r.text == want[r.doc_id] for r in got)
    a, b = (sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find(x).collect()) for x in (d, four))
    assert a == b


def test_pii_terms(spark):
    texts = ["Mail Zorblax now at a@b.cc ok", "then zorblax said a@b.cc fine", "Herr Zorblax, a@b.cc !", "nothing here", None, "to a@b.cc with then now", "copy Plim c@d.ee"] + ["copy Plim c@d.ee"] * 5
    d = docs(spark, texts)
    out = pii.sanitise(d)
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == "Mail [TERM] now at [EMAIL] ok" and got[2] == "Herr [TERM], [EMAIL] !" and got[3] == "nothing here" and got[4] is None
    assert got[5] == "to [EMAIL] with then now"  # words seen elsewhere tell nothing
    assert got[7] == "copy Plim [EMAIL]"  # copies are one context
    plan = pii.find(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_terms_of_whole_documents(spark):
    """Further than 64 characters from the match, and at every place of the document."""
    fill = ["some plain words stand here and go on for a while until the line is long " * 2 + w for w in ("one", "two", "three", "four")]
    texts = [f"Zorblax {f} at a@b.cc and {f} ends, zorblax." for f in fill[:3]] + [f"{f} stands alone at and ends" for f in fill] * 2 + ["mail k@l.mm for all of it, Dorn"] * 3
    got = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    for i, f in enumerate(fill[:3]):
        assert got[i] == f"[TERM] {f} at [EMAIL] and {f} ends, [TERM]."
    assert [got[i] for i in range(3, 11)] == texts[3:11] and got[11] == "mail [EMAIL] for all of it, Dorn"


def test_pii_terms_beside_other_digits_and_matches(spark):
    """No digit and no other match of the same kind, valid or not, ends what is seen of a document."""
    card = "4111 1111 1111 1111"
    texts = [f"Zorblax order {i}: {card} exp. 12/27 {w}" for i, w in enumerate(("red", "green", "blue"))] + ["order exp. red green blue"] * 7
    texts += [f"{w}: Plimmo x{i}@q.rr, k@l.mm, y{i}@q.rr; {w}" for i, w in enumerate(("red", "green", "blue"))]
    got = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    for i, w in enumerate(("red", "green", "blue")):
        assert got[i] == f"[TERM] order {i}: [CARD] exp. 12/27 {w}"
        assert "Plimmo" not in got[10 + i] and "[TERM] [EMAIL], [EMAIL], [EMAIL]; " in got[10 + i]


# op10


def lowest(n, links):
    """The smallest number that each of 0..n-1 is connected to."""
    low = list(range(n))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, j in links:
        a, b = top(i), top(j)
        low[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute_groups(texts, k):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    return [(len(s), low) for s, low in zip(sets, lowest(len(sets), links), strict=True)]


def test_parity_sketches_rule_out_only_what_is_apart():
    """Links inside and between chunks connect what brute force connects, at any sketch size."""
    rng = np.random.default_rng(13)
    for top in (1 << 12, 1 << 27):
        minhash.SKETCH_BITS, old = top, minhash.SKETCH_BITS
        try:
            base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 4, 90, 400)]
            sets = []
            for i in range(120):
                own = base[i % 4].copy()
                own[rng.random(len(own)) < 0.08] += np.uint64(i + 1)
                sets.append(np.unique(own))
            name = lambda i: i.to_bytes(16, "big")
            x, y = (minhash.Chunk([name(i) for i in own], [name(i) for i in own], [sets[i] for i in own]) for own in (range(60), range(60, 120)))
            x, y = minhash.Chunk.load(x.dump()), minhash.Chunk.load(y.dump())
            got = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in minhash.joins(x, x, 80) + minhash.joins(y, y, 80) + minhash.joins(x, y, 80)]
            near = lambda i, j: 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)
            assert all(near(i, j) for i, j in got) and len(minhash.joins(x, x, 80)) < 60
            assert lowest(120, got) == lowest(120, [(i, j) for i in range(120) for j in range(i) if near(i, j)])
        finally:
            minhash.SKETCH_BITS = old


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(11)
    texts = list(ODD) + ["A b", "a B", "b a"]
    for _ in range(8):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 10, 60, 200]))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 999)}"
            texts.append(" ".join(own))
    d = docs(spark, texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(d, k=2).collect()}
    want = brute_groups(texts, 2)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i][1] == i) for i in got)


def test_one_document_of_each_group_stays(spark):
    a, b, c = "one two three four five six seven eight nine ten eleven twelve", "a different text of some words that is long enough to be one", "!! alone"
    rows = [(1, a), (1, a), (2, a + " x"), (3, b), (3, b + " y"), (None, c), (None, c), (None, c + " z"), (5, ""), (5, ""), (None, None), (6, "x y"), (7, "X  y")]
    d = spark.createDataFrame([(*r, i, 0, 0, 0, "") for i, r in enumerate(rows)], "doc_id long, text string, n int, low int, gone int, id int, seen string")
    out = minhash.without_near_duplicates(d, k=2)
    assert out.columns == d.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert [g for g in got if g[1] not in (b, b + " y", c, c + " z")] == sorted([("1", a), ("5", ""), ("5", ""), ("None", "None"), ("6", "x y")])
    assert sum(g[1] in (b, b + " y") for g in got) == 1 and sum(g[1] in (c, c + " z") for g in got) == (1 if brute_groups([c, c + " z"], 2)[1][1] == 0 else 2)
    assert minhash.without_near_duplicates(d.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(12)
    a, b = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    x, y = np.unique(np.concatenate([a[:800], b[:200]])), np.unique(np.concatenate([a[:800], b[200:400]]))
    s = minhash.signatures(np.concatenate([x, y, a[:1]]), np.repeat([0, 1, 2], [len(x), len(y), 1]), 3)
    assert np.isfinite(s).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12
    assert sorted(np.floor(s[2]).astype(int)) == list(range(minhash.SLOTS))  # one shingle: every level once


def test_buckets_follow_the_bytes(spark, monkeypatch, tmp_path):
    d = docs(spark, ["x" * 1000] * 40)
    d.write.parquet(str(tmp_path / "d"))
    for table in (d, d.where("doc_id < 0"), spark.read.parquet(str(tmp_path / "d"))):
        assert wordblocks.buckets_of(table, "text") == 8
    monkeypatch.setattr(wordblocks, "BUCKET_BYTES", 1000)
    assert wordblocks.buckets_of(d, "text") == 40
