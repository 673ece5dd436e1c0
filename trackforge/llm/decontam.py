"""Benchmark decontamination, DataFrame functions only.

The n-grams of the benchmark (n consecutive words; a shorter item is one n-gram) form a hash
set. Every word position of every document hashes the window that starts there, inside one
generated stage, and probes the set; equal hashes are verified word by word. Only verified hits
and one row per document are shuffled.

Defined results:
- null or word-free texts: no words, not contaminated; null or word-free items: no windows
- repeated document rows (same id and text): one result; one id with different texts: one result each
- repeated items or item ids: each id counts once per document
- empty tables: no rows, or clean documents
- other columns, whatever their names, are never looked at by find_hits and pass through
  decontaminate unchanged
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm.common import ascii_words, sha_of_list, unused

#: Bytes of windows and item ids up to which the set is broadcast; beyond, a shuffle join.
BROADCAST_BYTES = 200 << 20
#: Words and the gaps between them, for texts in their own case.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def window_hash(words: Column, at: Column, n: int) -> Column:
    """Hash of words[at] .. words[at + n - 1]; only of meaning where they all exist."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def benchmark_windows(bench: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """_h, _win (array of words), _len, _items (array of item ids), one row per distinct window."""
    w = bench.select(F.col(item_id).cast("string").alias("_item"), ascii_words(F.col(text)).alias("_words"))
    w = w.where(F.size("_words") > 0).withColumn("_len", F.least(F.size("_words"), F.lit(n)))
    w = w.select("_item", "_len", "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("_len") + 1)).alias("_at"))
    w = w.select("_item", "_len", F.slice("_words", F.col("_at"), F.col("_len")).alias("_win"))
    w = w.groupBy("_win").agg(F.first("_len").alias("_len"), F.collect_set("_item").alias("_items"))
    h = F.xxhash64(*[F.get("_win", F.lit(i)) for i in range(n)])  # xxhash64 passes over nulls
    return w.select(h.alias("_h"), "_win", "_len", "_items")


def find_hits(docs: DataFrame, bench: DataFrame, *, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a benchmark window), items (ids, sorted
    as strings), spans (array of [start, end) word positions, merged), n_items, items_sha256,
    contaminated."""
    windows = benchmark_windows(bench, n, item_id, item_text)
    held = F.aggregate(F.concat("_win", "_items"), F.lit(100).cast("long"), lambda s, x: s + F.octet_length(x) + 40)
    sizes = {r["_len"]: r["c"] for r in windows.groupBy("_len").agg(F.sum(held).alias("c")).collect()}  # at most n rows
    small = sum(sizes.values()) <= BROADCAST_BYTES
    d = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), ascii_words(F.col(text)).alias("_words"))
    d = d.select("_doc", "_text", "_words", F.size("_words").alias("_n"), F.posexplode_outer("_words").alias("_pos", "_w")).drop("_w")
    lengths = sorted(sizes) or [n]
    grams = [F.when(F.col("_pos") + k <= F.col("_n"), window_hash(F.col("_words"), F.col("_pos"), k)) for k in lengths]
    if len(lengths) == 1:
        d = d.select("*", grams[0].alias("_g"), F.lit(lengths[0]).alias("_k"))
    else:
        d = d.select("*", F.explode(F.array(*[F.struct(g.alias("_g"), F.lit(k).alias("_k")) for g, k in zip(grams, lengths, strict=True)])).alias("_s")).select("_doc", "_text", "_words", "_n", "_pos", "_s._g", "_s._k")
    here = F.slice("_words", F.col("_pos") + 1, F.col("_k"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0  # kept for each document, hit or not
    if small:
        j = d.join(F.broadcast(windows), (F.col("_g") == F.col("_h")) & (F.col("_k") == F.col("_len")), "left")
        j = j.withColumn("_hit", F.coalesce(here == F.col("_win"), F.lit(False))).where(F.col("_hit") | first)
    else:
        own = d.where(F.col("_g").isNotNull()).select("_doc", "_text", "_n", "_pos", "_g", "_k", here.alias("_here"))
        found = own.join(windows, (F.col("_g") == F.col("_h")) & (F.col("_k") == F.col("_len")) & (F.col("_here") == F.col("_win")))
        cols = ["_doc", "_text", "_n", "_pos", "_len", "_items"]
        none = d.where(first).select("_doc", "_text", "_n", "_pos", F.lit(None).cast("int").alias("_len"), F.lit(None).cast("array<string>").alias("_items"))
        j = found.select(*cols).unionByName(none.select(*cols)).withColumn("_hit", F.col("_len").isNotNull())
    start = F.coalesce(F.col("_pos"), F.lit(0))
    hits = j.select("_doc", "_text", F.col("_n").cast("long").alias("_n"), start.alias("_start"), F.when(F.col("_hit"), start + F.col("_len")).otherwise(0).alias("_end"), F.when(F.col("_hit"), F.col("_items")).alias("_items"), "_hit")
    w = Window.partitionBy("_doc", "_text").orderBy("_start", "_end")
    before = F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.withColumn("_before", before)
    hits = hits.withColumn("_new", (F.col("_hit") & ((F.col("_start") > F.col("_before")) | (F.col("_before") == 0))).cast("int"))
    hits = hits.withColumn("_island", F.sum("_new").over(w))
    more = F.greatest(F.lit(0), F.col("_end") - F.greatest("_start", "_before"))
    span = hits.groupBy("_doc", "_text", "_island").agg(
        F.max("_n").alias("_n"), F.sum(more).alias("_more"), F.min(F.when(F.col("_hit"), F.col("_start"))).alias("start"), F.max(F.when(F.col("_hit"), F.col("_end"))).alias("end"),
        F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
    out = span.groupBy("_doc", "_text").agg(
        F.max("_n").alias("n_words"), F.sum("_more").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"))
    return out.select(
        F.col("_doc").alias(doc_id), F.col("_text").alias("text_hash"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha_of_list(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def decontaminate(docs: DataFrame, bench: DataFrame, *, mode: str = "document", n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    mode "document" drops contaminated documents; mode "span" keeps them without the words of the
    hit spans, and the text from each removed span's first to its last word goes with them.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode must be document or span, not {mode}")
    found = find_hits(docs, bench, n=n, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text)
    hit_doc, hit_text, hit_spans, words, gaps = unused(docs.columns, "hit_doc", "hit_text", "hit_spans", "words", "gaps")
    hit = found.where("contaminated").select(F.col(doc_id).alias(hit_doc), F.col("text_hash").alias(hit_text), F.col("spans").alias(hit_spans))
    on = docs[doc_id].eqNullSafe(hit[hit_doc]) & (F.xxhash64(docs[text]) == hit[hit_text])
    if mode == "document":
        return docs.join(hit, on, "left_anti")
    own = docs[text]
    j = docs.join(hit, on, "left").withColumns({words: F.when(F.col(hit_spans).isNotNull(), F.array_remove(F.split(own, GAP, -1), "")), gaps: F.when(F.col(hit_spans).isNotNull(), F.split(own, WORD, -1))})
    return j.select(*[F.coalesce(_without(F.col(words), F.col(gaps), F.col(hit_spans)), own).alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])


def _without(words: Column, gaps: Column, spans: Column) -> Column:
    """The text without the words in spans: what stands between one span's last word and the next one's
    first, in slices. Null if spans are."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(words)))

    def piece(a: Column, b: Column) -> Column:  # words a to b, each before the gap that follows it
        pairs = F.zip_with(F.slice(words, a + 1, b - a), F.slice(gaps, a + 2, b - a), lambda w, g: F.concat(w, g))
        return F.concat(F.when(a > 0, F.get(gaps, a)).otherwise(F.lit("")), F.array_join(pairs, ""))

    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(ends, starts, piece), ""))
