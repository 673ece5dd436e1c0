"""Personal data: patterns, and terms that give away what the patterns find. DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. One pass over the
texts cuts each by each pattern; matches and the gaps between them give places by a running sum.

Information-theoretic sanitisation: every match is an entity with information content
IC(e) = -log2 P(e). A word t of a document that holds e discloses PMI(e; t) = log2(P(e | t) / P(e))
bits of it, where P(e | t) is the share of the documents with t, in the whole corpus, that hold e,
wherever the two stand. If this is IC(e) - slack_bits or more, that is if t alone nearly tells e
(P(e | t) >= 2 ** -slack_bits), and the two were seen together in several different texts (copies,
up to all but letters, are one), then t is removed at all its places in the documents that hold e: a
word gives way to its kind. Of terms and counts every row of the table counts, repeated ones too, for
the entity and for the term alike.

The patterns say what the plain ones say, without unbounded recursion or backtracking:
- e-mail: a match can start only where its local part does, or where the last match ended; the
  domain is extended while a letter, or a dot and a letter, follows
- card: digit groups are what is left between two other characters in a row, or one that is
  neither digit, space nor hyphen

Defined results: null and empty texts have no spans; repeated rows (same id and text) give one
result, one id with different texts one each; empty tables give none; other columns are ignored by
find() and pass through sanitise() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm.common import Scratch, unused

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-])(?!\.[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BETWEEN_CARDS = r"[^0-9]{2,}|[^0-9 -]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
NOT_LETTER = r"[^\p{L}]+"
#: Bytes of candidate terms up to which their occurrences are counted by a broadcast join.
BROADCAST_BYTES = 10 << 20


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, v: Column) -> Column:
    n = F.length(_digits(v))
    parts = F.split(v, r"\.", -1)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, F.forall(parts, lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))))
        .when(kind == 2, F.when((n >= 13) & (n <= 19), _luhn(_digits(v))).otherwise(False))
        .when(kind == 3, (n >= 9) & (n <= 15)))


def _items(kind: int, gaps: Column, values: Column) -> Column:
    """Array of (kind, i, gap: characters before the value, v). gaps: one more than values."""
    row = lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), v.alias("v"))
    return F.transform(values, row)


def _matches(text: Column) -> Column:
    """All items of a text of all kinds."""
    none = F.from_json(F.lit("[]"), "array<struct<kind:int,i:int,gap:int,v:string>>")
    cut = lambda kind, pattern: _items(kind, F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    has = lambda pattern: F.regexp_like(text, F.lit(pattern))
    # Digit groups stand between the matches of BETWEEN_CARDS; those come before and after them.
    groups, between = F.split(text, BETWEEN_CARDS, -1), F.regexp_extract_all(text, F.lit(BETWEEN_CARDS), F.lit(0))
    some = F.exists(groups, lambda g: F.length(_digits(g)).between(13, 19))
    card = _items(2, F.concat(F.array(F.lit("")), between, F.array(F.lit(""))), groups)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), cut(0, EMAIL)).otherwise(none), F.when(has(r"[0-9]\.[0-9]"), cut(1, IP)).otherwise(none),
        F.when(has("[0-9][ -]?[0-9]"), F.when(some, card).otherwise(none)).otherwise(none), F.when(F.contains(text, F.lit("+")), cut(3, PHONE)).otherwise(none))


def base_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, seen (hash of the text), copies (rows of that id and text), kind, start, end, v: a row per
    valid match; each document has at least one row, if only with null kind."""
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("seen"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = d.select("doc", "seen", F.posexplode_outer(_matches(F.col("text"))).alias("p", "x")).select("doc", "seen", F.coalesce("p", F.lit(-1)).alias("p"), "x.*")
    own = [F.first(c).alias(c) for c in ("kind", "i", "gap", "v")]
    rows = rows.repartition("doc", "seen").groupBy("doc", "seen", "p").agg(F.count("*").alias("copies"), *own)
    w = Window.partitionBy("doc", "seen", "kind").orderBy("p")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("v")).over(w).cast("long"))
    rows = rows.withColumn("start", F.col("end") - F.length("v"))
    # Only a card group at the text's start or end can have a space or hyphen on its outside.
    outside = lambda pattern: ((F.col("kind") == 2) & F.regexp_like("v", F.lit(pattern))).cast("long")
    rows = rows.withColumns({"start": F.col("start") + outside("^[ -]"), "end": F.col("end") - outside("[ -]$")})
    ok = F.coalesce(_valid(F.col("kind"), F.col("v")), F.lit(False))
    only = lambda c: F.when(ok, F.col(c)).alias(c)
    return rows.select("doc", "seen", "copies", *map(only, ("kind", "start", "end", "v")))


def _same_document(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a and b joined on doc (null equals null) and seen."""
    b = b.withColumnsRenamed({"doc": "_doc", "seen": "_seen"})
    return a.join(b, a["doc"].eqNullSafe(b["_doc"]) & (a["seen"] == b["_seen"]), how).drop("_doc", "_seen")


def _terms(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, NOT_LETTER, -1), ""), F.lower))


def _documents_with(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """term, all: rows of docs (text) with each term asked about."""
    words = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 50), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        return words.join(F.broadcast(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("all"))
    # each task adds up its words first, so that frequent ones aren't shuffled one by one
    return words.groupBy("term").agg(F.count("*").alias("all")).join(asked, "term", "left_semi")


def _disclosing(docs: DataFrame, base: DataFrame, scratch: Scratch, min_contexts: int, slack_bits: float) -> tuple[DataFrame, DataFrame]:
    """(doc, seen, term: what is to go where; doc, seen, text of the documents in question)."""
    least = 2.0**-slack_bits
    s = base.where(F.col("kind").isNotNull())
    entity = F.xxhash64("kind", F.when(F.col("kind") >= 2, _digits(F.col("v"))).otherwise(F.lower("v")))
    holders = s.select("doc", "seen", "copies", entity.alias("entity")).groupBy("entity", "doc", "seen").agg(F.max("copies").alias("copies"))
    # Only entities of several texts can have terms, and only terms of few enough documents tell them.
    often = holders.groupBy("entity").agg(F.count_distinct("seen").alias("texts"), F.sum("copies").alias("mentions")).where(F.col("texts") >= min_contexts)
    holders = scratch.write(holders.join(often.select("entity", "mentions"), "entity"))
    keys = holders.groupBy("doc", "seen").agg(F.max("mentions").alias("most"))
    letters = F.xxhash64(F.lower(F.regexp_replace("text", NOT_LETTER, " "))).alias("letters")
    held = scratch.write(_same_document(docs, keys).dropDuplicates(["doc", "seen"]).select("doc", "seen", "text", "most", letters))
    words = held.select("doc", "seen", "letters", "most", F.explode(_terms(F.col("text"))).alias("term"))
    asked = scratch.write(words.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most")).where(F.col("n") >= min_contexts).select("term", "most"))
    few = _documents_with(docs, asked.select("term")).join(asked, "term").where(F.col("all") * least <= F.col("most")).select("term", "all")
    words = scratch.write(words.drop("most").join(few, "term"))
    pairs = _same_document(words, holders).where(F.col("all") * least <= F.col("mentions"))
    together = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("near"), F.count_distinct("letters").alias("texts"), F.first("all").alias("all"))
    told = together.where((F.col("texts") >= min_contexts) & (F.col("near") >= F.col("all") * least)).select("entity", "term")
    gone = scratch.write(holders.join(told, "entity").select("doc", "seen", "term").distinct())
    return gone, held.select("doc", "seen", "text")


def _places(held: DataFrame, gone: DataFrame) -> DataFrame:
    """doc, seen, start, end: the words of held that are to go."""
    t = _same_document(held, gone.select("doc", "seen").distinct(), "left_semi")
    words, gaps = F.array_remove(F.split("text", NOT_LETTER, -1), ""), F.split("text", r"\p{L}+", -1)
    rows = t.select("doc", "seen", F.posexplode(F.arrays_zip(words.alias("w"), gaps.alias("g"))).alias("p", "x")).select("doc", "seen", "p", F.col("x.w").alias("w"), F.length("x.g").alias("g"))
    rows = rows.where(F.col("w").isNotNull())
    w = Window.partitionBy("doc", "seen").orderBy("p")
    rows = rows.withColumn("end", F.sum(F.col("g") + F.length("w")).over(w).cast("long")).select("doc", "seen", (F.col("end") - F.length("w")).alias("start"), "end", F.lower("w").alias("word"))
    g = gone.withColumnsRenamed({"doc": "_doc", "seen": "_seen"})
    return rows.join(g, rows["doc"].eqNullSafe(g["_doc"]) & (rows["seen"] == g["_seen"]) & (rows["word"] == g["term"]), "left_semi").select("doc", "seen", "start", "end")


def spans_of(docs: DataFrame, scratch: Scratch, *, doc_id: str, text: str, min_contexts: int, slack_bits: float) -> DataFrame:
    """doc, seen, kind, start, end: base and term spans; each document has at least one row, if only
    with null kind. A term within a base span is part of that."""
    base = scratch.write(base_spans(docs, doc_id, text))
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("seen"), F.col(text).cast("string").alias("text"))
    gone, held = _disclosing(d, base, scratch, min_contexts, slack_bits)
    found = _places(held, gone).select("doc", "seen", F.lit(4).alias("kind"), "start", "end")
    rows = base.select("doc", "seen", "kind", "start", "end").unionByName(found)
    w = Window.partitionBy("doc", "seen").orderBy("start", F.col("kind") == 4).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.max(F.when(F.col("kind") < 4, F.col("end"))).over(w)
    return rows.withColumn("upto", upto).where(F.col("kind").isNull() | (F.col("kind") < 4) | F.col("upto").isNull() | (F.col("end") > F.col("upto"))).drop("upto")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_contexts: int = 3, slack_bits: float = 1.0) -> DataFrame:
    """doc_id, text_hash, spans (array of kind, start, end; code points, end exclusive; by KINDS, then
    start): one row per document.

    min_contexts: different texts that a term must be seen in with an entity; slack_bits: how far
    below the entity's information content a term's disclosure may be and still count.
    """
    rows = spans_of(docs, Scratch(docs.sparkSession, "pii"), doc_id=doc_id, text=text, min_contexts=min_contexts, slack_bits=slack_bits)
    spans = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end"))))
    out = rows.groupBy("doc", "seen").agg(spans.alias("spans"))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return out.select(F.col("doc").alias(doc_id), F.col("seen").alias("text_hash"), F.transform("spans", lambda s: F.struct(name(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_contexts: int = 3, slack_bits: float = 1.0) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; where spans overlap, the later
    one's rest. All other columns stay as they are."""
    rows = spans_of(docs, Scratch(docs.sparkSession, "pii"), doc_id=doc_id, text=text, min_contexts=min_contexts, slack_bits=slack_bits).where(F.col("kind").isNotNull())
    w = Window.partitionBy("doc", "seen").orderBy("start", "end", "kind")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("end") > F.col("before")).withColumn("start", F.greatest("start", "before"))
    own_doc, own_seen, own_spans = unused(docs.columns, "own_doc", "own_seen", "own_spans")
    spans = rows.groupBy("doc", "seen").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(own_spans)).select(F.col("doc").alias(own_doc), F.col("seen").alias(own_seen), own_spans)
    j = docs.join(spans, docs[doc_id].eqNullSafe(spans[own_doc]) & (F.xxhash64(docs[text]) == spans[own_seen]), "left")
    t, s = docs[text], spans[own_spans]
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"])
    part = lambda x, i: F.concat(F.substring(t, (end(i) + 1).cast("int"), (x["start"] - end(i)).cast("int")), name(x["kind"]))
    last = F.substring(t, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(t))
    new = F.when(s.isNull(), t).otherwise(F.concat(F.concat_ws("", F.transform(s, part)), last))
    return j.select(*[new.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])
