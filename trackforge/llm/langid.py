"""Language identification by rank-order n-gram profiles.

A text's letters are lower-cased, every run of other characters is one word border, and n-grams of
1 to ``longest`` characters within words (borders included) are counted. A language's profile is
its ``size`` most frequent n-grams over all its training texts; a document's profile is made alike
from the whole text. The distance is the out-of-place sum: how far each of the document's n-grams
is from its rank in the language's profile, ``size`` if it isn't there. Ties of counts are broken
by length and characters, so that ranks are the same on every machine.

Counting works on numpy arrays of many documents at once: n-grams are packed into integers over
the characters of the batch, sorted and run-length counted. Counts of a language are added within
a task first, then by n-gram across tasks.

Defined results: a null or empty text and one without a letter are "und" with score 0, as is every
text if no language was learnt; ties between languages go to the smaller name; repeated rows give
one result each; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.common import unused

BATCH_CHARS = 1_000_000
_WHITE = " "  # stands for a border; a letter is never a space


@dataclass(frozen=True)
class Profiles:
    """languages in order of name; ranks: n-gram -> (language number, rank) pairs."""

    languages: list[str]
    grams: dict[str, list[tuple[int, int]]]
    size: int
    longest: int


class _Text:
    """Documents as one array of character numbers. Number 0 is a border; letters follow in code
    point order, so that integers order n-grams of one length as their strings do."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(t.lower() for t in texts)
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.append(points, np.uint32(10))
        some = np.flatnonzero(np.bincount(points))
        letters = np.array([p for p in some.tolist() if chr(p).isalpha()], np.int64)
        number = np.zeros(int(some[-1]) + 1, np.int64)
        number[letters] = np.arange(1, len(letters) + 1)
        self.alphabet = _WHITE + "".join(map(chr, letters.tolist()))
        chars = number[points]
        doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0) | (doc[1:] != doc[:-1])  # one border at a time
        self.chars, self.doc, self.n = chars[keep], doc[keep], len(texts)
        # a document begins with a border, too
        starts = np.flatnonzero(np.diff(self.doc, prepend=-1))
        at = starts[self.chars[starts] != 0]
        self.chars, self.doc = np.insert(self.chars, at, 0), np.insert(self.doc, at, self.doc[at])
        self.has_letter = np.bincount(self.doc[self.chars != 0], minlength=self.n) > 0

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, packed n-gram) of every n-gram without a border inside, 1-grams of letters only."""
        c, a = self.chars, len(self.alphabet)
        m = len(c) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, ok = c[:m].copy(), self.doc[:m] == self.doc[n - 1 :]
        for i in range(1, n):
            code = code * a + c[i : i + m]
            if i < n - 1:
                ok &= c[i : i + m] != 0
        if n == 1:
            ok &= c != 0
        return self.doc[:m][ok], code[ok]

    def name(self, code: int, n: int) -> str:
        a, out = len(self.alphabet), []
        for _ in range(n):
            code, r = divmod(code, a)
            out.append(self.alphabet[r])
        return "".join(reversed(out))


def _counted(group: np.ndarray, code: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, count) of equal pairs."""
    key = np.sort(group * span + code)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, count = key[first], np.diff(np.append(first, len(key)))
    return key // span, key % span, count


def _batches(column: pa.Array, rows: list[int]) -> Iterator[tuple[list[int], list[str]]]:
    held, texts, size = [], [], 0
    for i in rows:
        t = column[i].as_py() or ""
        held.append(i)
        texts.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def learn(docs: DataFrame, training: Column, *, text: str = "text", lang: str = "lang", size: int = 400, longest: int = 3, most_languages: int = 2_000) -> Profiles:
    """Profiles from all documents for which training is true and text and lang are not null. They are sent
    to every task, so more than most_languages are an error; size entries for each are some 50 bytes long."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            for held, texts in _batches(b.column(0), list(range(b.num_rows))):
                own = np.array([names.index(langs[i]) for i in held])
                t = _Text(texts)
                for n in range(1, longest + 1):
                    doc, code = t.grams(n)
                    for g, c, k in zip(*(x.tolist() for x in _counted(own[doc], code, len(t.alphabet) ** n)), strict=True):
                        key = (names[g], t.name(c, n))
                        total[key] = total.get(key, 0) + k
            if len(total) > 2_000_000:
                yield _rows(total)
                total = {}
        if total:
            yield _rows(total)

    def _rows(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "c"])

    d = docs.where(F.coalesce(training, F.lit(False)) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    grams = d.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("lang").orderBy(F.desc("c"), F.length("gram"), "gram")
    top = grams.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    rows = top.select("lang", "gram", "rank").limit(most_languages * size + 1).collect()
    languages = sorted({r["lang"] for r in rows})
    if len(rows) > most_languages * size:
        raise ValueError(f"more than {most_languages} languages")
    number = {x: i for i, x in enumerate(languages)}
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["gram"], []).append((number[r["lang"]], r["rank"] - 1))
    return Profiles(languages, out, size, longest)


def _distances(t: _Text, p: Profiles) -> np.ndarray:
    """documents x languages: mean out-of-place distance, as a share of the profile's size."""
    docs, codes, counts, lengths = [], [], [], []
    for n in range(1, p.longest + 1):
        d, c, k = _counted(*t.grams(n), len(t.alphabet) ** n)
        docs.append(d), codes.append(c), counts.append(k), lengths.append(np.full(len(d), n))
    doc, code, count, length = map(np.concatenate, (docs, codes, counts, lengths))
    order = np.lexsort((code, length, -count, doc))
    doc, code, length = doc[order], code[order], length[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    top = rank < p.size
    doc, code, length, rank = doc[top], code[top], length[top], rank[top]
    languages = len(p.languages)
    a = len(t.alphabet)
    look = {x: i for i, x in enumerate(t.alphabet)}
    total = np.zeros((t.n, languages))
    many = np.bincount(doc, minlength=t.n)
    for n in range(1, p.longest + 1):
        known = {}
        for g, at in p.grams.items():
            if len(g) == n and all(x in look for x in g):
                c = 0
                for x in g:
                    c = c * a + look[x]
                known[c] = at
        place = np.array(sorted(known), np.int64)
        of = np.full((len(place) + 1, languages), -1, np.int64)
        for i, c in enumerate(place.tolist()):
            for lang, r in known[c]:
                of[i, lang] = r
        own = length == n
        c, r, d = code[own], rank[own], doc[own]
        at = np.searchsorted(place, c)
        at[(at == len(place)) | (np.append(place, -1)[np.minimum(at, len(place))] != c)] = len(place)
        for lang in range(languages):
            ranks = of[at, lang]
            total[:, lang] += np.bincount(d, weights=np.where(ranks < 0, p.size, np.abs(ranks - r)), minlength=t.n)
    return total / (np.maximum(many, 1)[:, None] * p.size)


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of docs, without any that have the names of the two new ones, and these: the language,
    and a score from 0 to 1 (1: no n-gram out of place)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    others = [f for f in docs.schema.fields if f.name.lower() not in {x.lower() for x in to}]
    schema = T.StructType([*others, T.StructField(to[0], T.StringType()), T.StructField(to[1], T.DoubleType())])
    d = docs.select(F.col(f"`{text}`").cast("string").alias(unused([f.name for f in others], "said")[0]), *[F.col(f"`{f.name}`") for f in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for held, texts in _batches(b.column(0), list(range(b.num_rows))) if p.languages else ():
                t = _Text(texts)
                d = _distances(t, p)
                best = d.argmin(1)
                own = np.array(held)[t.has_letter]
                lang[own] = np.array(p.languages, object)[best][t.has_letter]
                score[own] = np.clip(1 - d.min(1), 0, 1)[t.has_letter]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return d.mapInArrow(run, schema)
