"""How far each source's use of terms lies from that of the other sources of its language, and of the
language as a whole: a triangular discrimination of smoothed term shares, in exact integers.

A sum over all kept terms for each pair of groups costs groups squared times terms if it is taken
term by term. By inclusion and exclusion over the two supports it is

* for terms of one group, whatever the other has: prices at the other's share of an absent term. They
  depend on the count only, so a histogram of a group's counts prices its whole support;
* for terms of both: what that got wrong, from a join of the postings of each term;
* for terms of neither: a constant times their number.

Words are counted in tasks (a bounded dictionary each) before anything is shuffled, so neither a
frequent term nor a source with most of the rows makes a large group. The postings of a term are a
row for each source at most; they are joined within buckets of terms, which give one sum a pair of
sources.

Null text, lang and source are ''. Empty texts count for their group, which exists without terms, too.
Repeated rows count as often as they stand there; doc_id isn't read, so it may be null or absent. Ties
of values are ranked by the item's UTF-8. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm.common import LOWER, UPPER, Scratch, bounded_batches

SCALE = 1_000_000_000
#: A term must stand in so many documents of a language.
LEAST_DOCS = 10
#: Entries of a task's dictionary before it is written out, and bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 20
#: Postings that one bucket of terms is to have.
BUCKET_POSTINGS = 200_000
_TERM, _PART = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _terms(text: memoryview, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; pieces end between terms."""
    at = 0
    while at < len(text):
        end = min(at + piece, len(text))
        own = bytes(text[at:end]).translate(_LOWER)
        while end < len(text):
            more = bytes(text[end : end + 4096]).translate(_LOWER)
            cut = _PART.search(more)
            own += more[: cut.start()] if cut else more
            end += cut.start() if cut else len(more)
            if cut:
                break
        yield _TERM.findall(own)
        at = end


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): sums within tasks, several rows a term. Each
    group has a row of the empty term, too."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, of) in held.items():
                terms = [b"", *n]
                yield pa.RecordBatch.from_arrays([
                    pa.array([a]).take(pa.array(np.zeros(len(terms), np.int32))), pa.array([b]).take(pa.array(np.zeros(len(terms), np.int32))), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(of.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(2)
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n, of = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for terms in _terms(memoryview(texts[i].as_buffer())):
                    n.update(terms)
                    seen.update(terms)
                of.update(seen)
                size += len(n)
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    with bounded_batches(docs.sparkSession):
        return d.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, terms: str) -> Column:
    """A term's share from its count, the count of all, and the number of terms; null without any. Decimals, as
    a billion times a count beyond nine billion is no long."""
    return F.expr(f"1 + ({SCALE} * cast({count} + 2 as decimal(20,0))) div nullif(cast({total} as decimal(20,0)) + 2 * cast({terms} as decimal(20,0)), 0)")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _overlaps(table: pa.Table) -> pa.Table:
    """Of one bucket of a language's terms: for each two sources (a before b) that share terms, how many, and
    what the one-sided prices of these terms got wrong, but for the price of absence on both sides."""
    f = lambda p, q: (p - q) ** 2 // (p + q)
    t = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    source, p, p0 = (table.column(c).to_numpy() for c in ("ix", "p", "p0"))
    order = np.lexsort((source, t))
    t, source, p, p0 = t[order], source[order].astype(np.int64), p[order], p0[order]
    end = np.searchsorted(t, t, side="right")
    by = np.argsort(source, kind="stable")
    cut = np.flatnonzero(np.diff(source[by], prepend=-1))
    out: list[list[np.ndarray]] = [[], [], [], []]
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):
        at = by[lo:hi]
        n = end[at] - at - 1
        if not n.sum():
            continue
        other = np.repeat(at + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.repeat(p[at], n)
        wrong = f(own, p[other]) - f(own, p0[other]) - f(p0[at[0]], p[other])
        b, where = np.unique(source[other], return_inverse=True)
        total = np.zeros(len(b), np.int64)
        np.add.at(total, where, wrong)
        for to, v in zip(out, (np.full(len(b), source[at[0]]), b, np.bincount(where), total), strict=True):
            to.append(v)
    a, b, both, wrong = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
    return pa.table({"lang": table.column("lang").combine_chunks().take(pa.array(np.zeros(len(a), np.int64))), "a": a, "b": b, "both": both, "wrong": wrong})


#: Groups (a language's source) up to which their sums are broadcast; each is a row of some 100 bytes.
BROADCAST_GROUPS = 50_000


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: each other source of the language, with the distance
    between the two; part term: the ``top`` terms that a source uses more than its language does."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.write(term_counts(docs, text=text, lang=lang, source=source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    postings = scratch.write(counts.drop("docs").join(kept, ["lang", "term"]))
    langs = postings.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_all"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("own_all"), F.count("*").alias("own_v"))
    none = {c: 0 for c in ("own_all", "own_v", "v", "lang_all")}
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(none)
    groups = scratch.write(groups.withColumn("ix", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).withColumn("p0", share("0", "own_all", "v")))
    n_groups, n_postings = groups.count(), postings.count()
    near = (lambda g: F.broadcast(g)) if n_groups <= BROADCAST_GROUPS else (lambda g: g)

    own = postings.join(near(groups), ["lang", "source"]).withColumn("p", share("n", "own_all", "v"))
    terms = own.withColumn("q", share("lang_n", "lang_all", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    buckets = max(1, -(-n_postings // BUCKET_POSTINGS))
    dealt = own.select("lang", "term", "ix", "p", "p0").groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    both = dealt.applyInArrow(_overlaps, "lang string, a long, b long, both long, wrong long").groupBy("lang", "a", "b").agg(F.sum("both").alias("both"), F.sum("wrong").alias("wrong"))

    prices = own.groupBy("lang", "ix", "n").agg(F.count("*").alias("terms"), F.first("p").alias("p"))  # a histogram of each group's counts
    other = groups.select("lang", F.col("ix").alias("other"), F.col("p0").alias("q0"))
    one_sided = prices.join(near(other), "lang").where("ix <> other").groupBy("lang", F.least("ix", "other").cast("long").alias("a"), F.greatest("ix", "other").cast("long").alias("b")).agg(F.sum(F.col("terms") * distance("p", "q0")).alias("one_sided"))

    def named(*keep: str, to: str) -> DataFrame:
        return groups.select("lang", F.col("ix").cast("long").alias(to), *[F.col(c).alias(f"{c}_{to}") for c in keep])

    pairs = named("source", "own_v", "p0", "v", to="a").join(near(named("source", "own_v", "p0", to="b")), "lang").where("a < b")
    pairs = pairs.join(one_sided, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    neither = F.col("v_a") - F.col("own_v_a") - F.col("own_v_b") + F.coalesce("both", F.lit(0))
    value = F.coalesce(F.coalesce("one_sided", F.lit(0)) + F.coalesce("wrong", F.lit(0)) + neither * F.coalesce(distance("p0_a", "p0_b"), F.lit(0)), F.lit(0)).cast("long")
    way = lambda x, y: F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"))
    pairs = pairs.select("lang", value.alias("value"), F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
