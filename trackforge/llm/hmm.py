"""Scoring texts with a hidden Markov language model.

Tokens are words and one end per document. Latent states move by A and emit words by B; every
word of the training documents has emissions of its own in each state, and one place is left for
unknown words. The expected emission counts are a distributed table by word that grows with the
corpus: each block of documents adds up its own words' counts and sends them, packed, to the
words' buckets; there they are added up, and go back to the blocks that hold the words. To the
driver come only starts, moves, sums by state and the likelihood. Rounds of Baum-Welch end when that gains
little more; then the scaled forward recursion gives each text's exact log likelihood.

Within a block, documents are laid end to end in lanes that run side by side; a document's first
token starts anew from the initial distribution. A text longer than a chunk runs in pieces that
hand on their state, so that memory is bounded and nothing is left out. Counts travel as 32-bit floats.

Defined results: a null or empty text is one end token; repeated rows and ids give one result each;
no training documents leave a uniform model (every word unknown); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.common import Scratch
from trackforge.llm.wordblocks import bucketed, messages_of, pack, pack_wide, reply_order, unpack, unpack_wide, unpack_words, word_blocks

END = 0  # the end token's symbol
ADD = 0.1  # added to every count


@dataclass(frozen=True)
class Config:
    """states: latent states. rounds: of Baum-Welch at most. least_gain: of the training likelihood's
    logarithm in a round, as a share of it, for another round to follow."""

    states: int = 4
    rounds: int = 4
    least_gain: float = 2e-3
    seed: int = 1


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # K x symbols


@dataclass
class Shared:
    """What all blocks need besides their own words' counts. end, total: expected counts of the end
    token and of all tokens in each state; known: distinct tokens of the training documents."""

    start: np.ndarray
    move: np.ndarray
    end: np.ndarray
    total: np.ndarray
    known: int

    def model(self, words: np.ndarray) -> Model:
        """With the end and a block's words (words x K expected counts) as symbols."""
        e = np.concatenate([self.end[None], words]).T + ADD
        return Model(self.start, self.move, e / (self.total + ADD * (self.known + 1))[:, None])


def split_words(text: str) -> list[bytes]:
    """ASCII white space parts words (9 to 13 and 32); only A-Z is made lower case."""
    return text.encode().lower().split()


#: Tokens whose passes run side by side; a longer text runs alone, in pieces of this length.
CHUNK = 1_000_000
LANES = 512


class _Pass:
    """Scaled recursions over lanes of tokens (time x lanes), each beginning at a document's start
    or, for a piece of a long text, with the state distribution ``before`` its first token."""

    def __init__(self, model: Model, x: np.ndarray, first: np.ndarray, before: np.ndarray | None = None):
        self.m, self.x = model, x
        n, lanes = x.shape
        self.resets = {int(t): np.flatnonzero(first[t]) for t in np.flatnonzero(first.any(1))}
        self.e = np.ascontiguousarray(model.emit.T)[x]
        self.alpha, self.scale = np.empty_like(self.e), np.empty((n, lanes))
        ones = np.ones(len(model.start))
        self.before = now = np.tile(model.start, (lanes, 1)) if before is None else before
        for t in range(n):
            at = np.dot(now, model.move, out=self.alpha[t])
            if (r := self.resets.get(t)) is not None:
                at[r] = model.start
            at *= self.e[t]
            s = np.dot(at, ones, out=self.scale[t])
            at /= s[:, None]
            now = at

    def back(self, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state posteriors, expected moves, beta before the first token). after: beta at the end."""
        n, lanes, k = self.e.shape
        beta = np.empty_like(self.e)
        beta[-1] = 1 if after is None else after
        turned = np.ascontiguousarray(self.m.move.T)
        to = self.e
        for t in range(n - 1, -1, -1):
            to[t] *= beta[t]
            to[t] /= self.scale[t][:, None]
            if t:
                np.dot(to[t], turned, out=beta[t - 1])
                if (r := self.resets.get(t)) is not None:
                    beta[t - 1][r] = 1
        first = to[0] @ turned
        for t, r in self.resets.items():
            to[t][r] = 0  # no move leads into a first token
        moves = self.alpha[:-1].reshape(-1, k).T @ to[1:].reshape(-1, k) + self.before.T @ to[0]
        beta *= self.alpha
        return beta, moves * self.m.move, first


class Chain:
    """log10 probabilities and expected counts of the symbols of many documents."""

    def __init__(self, model: Model, symbols: np.ndarray, lens: np.ndarray):
        self.m, self.x, self.lens = model, symbols, lens
        self.starts = np.cumsum(lens) - lens

    def _chunks(self) -> Iterator[np.ndarray]:
        """Documents by length, in groups of at most CHUNK tokens with the padding of their lanes."""
        order, held, size = np.argsort(-self.lens, kind="stable"), [], 0
        for d in order:
            if held and size + self.lens[d] > CHUNK:
                yield np.array(held)
                held, size = [], 0
            held.append(d)
            size += int(self.lens[d])
        if held:
            yield np.array(held)

    def _lanes(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place (time, lane) of each document's first token: longest first into lanes of one height."""
        lens = self.lens[docs]
        height = max(int(lens[0]), -(-int(lens.sum()) // LANES))
        t, lane, room, now = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), [height], 0
        for i, n in enumerate(lens.tolist()):
            if room[now] < n:
                room.append(height)
                now = len(room) - 1
            t[i], lane[i] = height - room[now], now
            room[now] -= n
        self.height, self.width = height, len(room)
        return t, lane

    def _run(self, each) -> None:
        for docs in self._chunks():
            if len(docs) == 1 and self.lens[docs[0]] > CHUNK:
                each(docs, None, None)
                continue
            t, lane = self._lanes(docs)
            lens = self.lens[docs]
            inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            src, row, col = np.repeat(self.starts[docs], lens) + inner, np.repeat(t, lens) + inner, np.repeat(lane, lens)
            x, first = np.zeros((self.height, self.width), np.int64), np.ones((self.height, self.width), bool)  # padding: documents of one token
            x[row, col], first[row, col] = self.x[src], inner == 0
            each(docs, _Pass(self.m, x, first), (row, col, src))

    def _pieces(self, doc: int) -> list[tuple[int, int]]:
        a, n = int(self.starts[doc]), int(self.lens[doc])
        return [(a + i, a + min(n, i + CHUNK)) for i in range(0, n, CHUNK)]

    def _piece(self, a: int, b: int, doc: int, before) -> _Pass:
        first = np.zeros((b - a, 1), bool)
        first[0, 0] = a == self.starts[doc]
        return _Pass(self.m, self.x[a:b].astype(np.int64)[:, None], first, before)

    def log10(self) -> np.ndarray:
        """Of each document."""
        out = np.zeros(len(self.lens))

        def each(docs, p, places):
            if p is None:
                before = None
                for a, b in self._pieces(docs[0]):
                    q = self._piece(a, b, docs[0], before)
                    before = q.alpha[-1].copy()
                    out[docs[0]] += np.log10(q.scale).sum()
            else:
                lens = self.lens[docs]
                out[docs] = np.add.reduceat(np.log10(p.scale[places[0], places[1]]), np.cumsum(lens) - lens)

        self._run(each)
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts (K), moves (K x K) and emissions (K x symbols), and the log10
        probability of all documents."""
        k, s = self.m.emit.shape
        starts, moves, emits, log10 = np.zeros(k), np.zeros((k, k)), np.zeros((k, s)), 0.0

        def count(x, g):
            for j in range(k):
                emits[j] += np.bincount(x, weights=g[:, j], minlength=s)

        def each(docs, p, places):
            nonlocal starts, moves, log10
            if p is None:
                before, befores = None, []
                for a, b in self._pieces(docs[0]):
                    befores.append(before)
                    q = self._piece(a, b, docs[0], before)
                    before = q.alpha[-1].copy()
                    log10 += float(np.log10(q.scale).sum())
                after = None
                for (a, b), before in reversed(list(zip(self._pieces(docs[0]), befores, strict=True))):
                    g, m, after = self._piece(a, b, docs[0], before).back(after)
                    moves += m
                    count(self.x[a:b], g[:, 0])
                starts += g[0, 0]
            else:
                row, col, src = places
                log10 += float(np.log10(p.scale[row, col]).sum())
                g, m, _ = p.back()
                moves += m
                g = g[row, col]
                count(self.x[src], g)
                lens = self.lens[docs]
                starts += g[np.cumsum(lens) - lens].sum(0)

        self._run(each)
        return starts, moves, emits, log10


def _pack_floats(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, np.float32).ravel().view(np.uint32))


def _unpack_floats(packed: bytes, n: int, k: int) -> np.ndarray:
    return unpack(packed, n * k).view(np.float32).reshape(n, k).astype(np.float64)


def first_weights(words: list[bytes], cfg: Config) -> np.ndarray:
    """words x K random factors that tell the states apart at first, by each word's hash."""
    if not words:
        return np.zeros((0, cfg.states))
    held = np.empty(len(words), object)
    held[:] = words
    h = pd.util.hash_array(held, categorize=False)[:, None] + np.arange(1, 2 * cfg.states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(cfg.seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    normal = np.sqrt(-2 * np.log(u[:, : cfg.states])) * np.cos(2 * np.pi * u[:, cfg.states :])
    return np.exp(0.5 * normal)


LINKS = "bucket int, block long, n int, places binary, counts binary, weights binary, known long, tokens long, sums array<double>"
REPLY = "to long, bucket int, n int, weights binary, counts binary"


def word_links(messages: DataFrame, cfg: Config) -> DataFrame:
    """The written table, by bucket, of the words' places: for each block the places of its words
    among the bucket's; and, with block -1, the bucket's own row: training counts and first expected
    counts of its n words, how many are known, and sums over them."""

    def run(table: pa.Table) -> pa.Table:
        place, counts, rows = {}, [], []
        bucket = table.column("bucket")[0].as_py()
        for block, n, size, words, own in zip(*(table.column(c).to_pylist() for c in ("block", "n", "size", "words", "counts")), strict=True):
            at = np.fromiter((place.setdefault(w, len(place)) for w in unpack_words(words, size)), np.int64, n)
            counts.append((at, unpack_wide(own, n)))
            rows.append({"bucket": bucket, "block": block, "n": n, "places": pack(at)})
        c = np.zeros(len(place), np.int64)
        for at, own in counts:
            c[at] += own.astype(np.int64)
        w = c[:, None] * first_weights(list(place), cfg)
        rows.append({"bucket": bucket, "block": -1, "n": len(c), "counts": pack_wide(c), "weights": _pack_floats(w), "known": int((c > 0).sum()), "tokens": int(c.sum()), "sums": w.sum(0).tolist()})
        return pa.Table.from_pylist(rows, schema)

    schema = messages.sparkSession.createDataFrame([], LINKS).toArrow().schema
    return bucketed(messages.groupBy("bucket").applyInArrow(run, LINKS), "bucket", "links")


def replies_of(links: DataFrame, sent: DataFrame | None, cfg: Config, with_counts: bool) -> DataFrame:
    """To each block and bucket: the expected counts of the block's words over all blocks (before the
    first round: the first ones), and their training counts if asked for."""
    k = cfg.states
    schema = links.sparkSession.createDataFrame([], REPLY).toArrow().schema

    def reply(links: pa.Table, sent: pa.Table | None) -> pa.Table:
        if not links.num_rows:
            return schema.empty_table()
        blocks, n, places = (links.column(c).to_pylist() for c in ("block", "n", "places"))
        own = blocks.index(-1)
        at = {b: unpack(p, m) for b, m, p in zip(blocks, n, places, strict=True) if b >= 0}
        c = unpack_wide(links.column("counts")[own].as_py(), n[own])
        if sent is None:
            w = _unpack_floats(links.column("weights")[own].as_py(), n[own], k)
        else:
            sent, w = sent.sort_by("block"), np.zeros((n[own], k))
            for b, part in zip(sent.column("block").to_pylist(), sent.column("weights"), strict=True):
                w[at[b]] += _unpack_floats(part.as_py(), len(at[b]), k)
        bucket = links.column("bucket")[0].as_py()
        rows = [{"to": b, "bucket": bucket, "n": len(i), "weights": _pack_floats(w[i]), "counts": pack_wide(c[i]) if with_counts else None} for b, i in at.items()]
        return pa.Table.from_pylist(rows, schema)

    asked = links.select("bucket", "block", "n", "places", "counts", "weights")
    if sent is None:
        return asked.groupBy("bucket").applyInArrow(lambda t: reply(t, None), REPLY)
    return asked.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(reply, REPLY)


def _block(left: pa.Table, right: pa.Table, k: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """A block, its symbols (0: end; word numbers from 1), tokens per document, its words' expected
    counts, and the replies in order."""
    block, right = left.slice(0, 1).to_pylist()[0], right.sort_by("bucket")
    parts = [_unpack_floats(w.as_py(), n, k) for n, w in zip(right.column("n").to_pylist(), right.column("weights"), strict=True)]
    words = reply_order(block, [np.zeros((0, k)), *parts])
    lens = np.array(block["lens"], np.int64)
    codes = unpack(block["codes"], int(lens.sum()))
    return block, np.insert(codes + np.uint32(1), np.cumsum(lens), END).astype(np.uint32), lens + 1, words, right


def train(blocks: DataFrame, links: DataFrame, cfg: Config, shared: Shared, scratch: Scratch) -> tuple[Shared, DataFrame | None]:
    """Baum-Welch: the shared part of the model, and the table of expected counts that blocks sent last.
    To the driver come K + K*K + 2 K + 1 sums; all that is by word stays distributed. Each round scores
    the training tokens by the model of the round before, so the last model is one better than the last
    likelihood seen."""
    k, spark = cfg.states, blocks.sparkSession
    up = "block long, bucket int, weights binary, sums array<double>"
    schema = spark.createDataFrame([], up).toArrow().schema

    def expected(now: Shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return schema.empty_table()
            block, symbols, lens, words, right = _block(left, right, k)
            flags = np.array(block["flags"], bool)
            symbols, lens = symbols[np.repeat(flags, lens)], lens[flags]
            if not len(symbols):
                return schema.empty_table()
            starts, moves, emits, log10 = Chain(now.model(words), symbols, lens).expected()
            rows = [{"block": block["block"], "bucket": -1, "sums": [*starts, *moves.ravel(), *emits[:, 0], *emits.sum(1), log10]}]
            sent, i = emits[:, 1:].T[unpack(block["order"], len(words))], 0
            for bucket, n in zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), strict=True):
                rows.append({"block": block["block"], "bucket": bucket, "weights": _pack_floats(sent[i : i + n])})
                i += n
            return pa.Table.from_pylist(rows, schema)

        return run

    stream, sent, table, last = blocks.select("block", "flags", "lens", "codes", "order"), None, None, None
    for _ in range(cfg.rounds):
        replies = replies_of(links, sent, cfg, False)
        new = scratch.write(stream.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(expected(shared), up))
        if table is not None:
            scratch.drop(table)
        table, sent = new, new.where("bucket >= 0").select("block", "bucket", "weights")
        rows = table.where("bucket < 0").select(F.posexplode("sums").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(k + k * k + 2 * k + 1)
        for r in rows:
            total[r["cell"]] = r["v"]
        starts, moves = total[:k] + ADD, total[k : k + k * k].reshape(k, k) + ADD
        shared = Shared(starts / starts.sum(), moves / moves.sum(1, keepdims=True), total[-2 * k - 1 : -k - 1], total[-k - 1 : -1], shared.known)
        del replies, new
        spark._jvm.System.gc()  # lets go of the shuffle files of the round
        if last is not None and total[-1] - last < cfg.least_gain * abs(last):
            break
        last = total[-1]
    return shared, sent


def score(docs: DataFrame, training: Column, *, cfg: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score (unigram), score (the model's):
    log10 probabilities, one row per row of docs. training: whether a row's words are learnt from;
    null counts as no."""
    scratch, k = Scratch(docs.sparkSession, "hmm"), cfg.states
    blocks = word_blocks(docs, split_words, doc_id=doc_id, text=text, flag=training)
    links = word_links(messages_of(blocks), cfg)
    ends = blocks.select(F.explode("flags").alias("f")).agg(F.coalesce(F.sum(F.col("f").cast("long")), F.lit(0)).alias("n")).first()["n"]
    sums = links.where("block < 0").agg(F.sum("known").alias("known"), F.sum("tokens").alias("tokens"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    total, known = ends + (sums["tokens"] or 0), (sums["known"] or 0) + (ends > 0)
    below = total + ADD * (known + 1)
    end = ends * first_weights([b"\xff"], cfg)[0]  # in no word
    move = np.full((k, k), 0.3 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.7 if k > 1 else 1.0)
    shared = Shared(np.full(k, 1 / k), move, end, end + np.array([sums[f"s{i}"] or 0.0 for i in range(k)]), known)
    shared, sent = train(blocks, links, cfg, shared, scratch)
    rows = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("trained", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    schema = docs.sparkSession.createDataFrame([], rows).toArrow().schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        block, symbols, lens, words, right = _block(left, right, k)
        parts = [unpack_wide(c.as_py(), n).astype(np.float64) for n, c in zip(right.column("n").to_pylist(), right.column("counts"), strict=True)]
        counts = np.concatenate([[float(ends)], reply_order(block, [np.zeros(0), *parts])])
        of_docs = lambda values: np.add.reduceat(values[symbols], np.cumsum(lens) - lens)
        base, n_known = of_docs(np.log10((counts + ADD) / below)), of_docs((counts > 0).astype(np.int64))
        scores = Chain(shared.model(words), symbols, lens).log10()
        columns = [pa.array(block["docs"], schema.field("id").type), pa.array(block["flags"], pa.bool_()), pa.array(lens), pa.array(n_known), pa.array(base), pa.array(scores)]
        return pa.Table.from_arrays(columns, schema=schema)

    stream = blocks.select("block", "docs", "flags", "lens", "codes", "order")
    scored = stream.groupBy("block").cogroup(replies_of(links, sent, cfg, True).groupBy("to")).applyInArrow(run, rows)
    return scored.select(F.col("id").alias(doc_id), "trained", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
