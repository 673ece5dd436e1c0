"""License scans by diagonal voting.

Templates (license texts, notices and phrases) are cut into word k-grams; so is every document, whole,
in one generated stage. Equal hashes join a document position to template positions and vote for the
diagonal document position - template position. Votes are summed per diagonal before and after the
shuffle. A few words inserted or left out shift the diagonal, so the votes of all diagonals within
``gap`` of one are its own as well; a diagonal that has more than any other within that reach is a
span, which gathers those neighbours and no others. It is kept if it covers enough of the template's
k-grams. An exact phrase is a template whose diagonal must have all its votes.

Defined results: null, empty or word-free texts have no words and no labels; templates of fewer words than
a k-gram are never found; repeated document rows (same id and text) give one result, one id with different texts one each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm import license_texts as texts
from trackforge.llm.common import ascii_words
from trackforge.llm.decontam import window_hash

#: Template positions up to which they are broadcast (about 200 bytes each); beyond, a shuffle join.
BROADCAST_POSITIONS = 500_000


@dataclass(frozen=True)
class Template:
    """name is unique; exact: a phrase, found only where all its words stand consecutively."""

    name: str
    label: str
    text: str
    exact: bool = False


#: The phrases and labels asked for.
PHRASES = (
    Template("mit-phrase", "mit", "mit license", True),
    Template("apache-phrase", "apache", "apache license", True),
    Template("gpl-phrase", "gpl", "general public license", True),
)
#: Whole texts and notices, and lines that stand for a license by themselves.
NOTICES = (
    Template("mit", "mit", texts.MIT),
    Template("mit-grant", "mit", texts.MIT.partition("\n\n")[0]),
    Template("bsd-2", "bsd", texts.BSD_2),
    Template("bsd-3", "bsd", texts.BSD_3),
    Template("bsd-conditions", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "isc", texts.ISC),
    Template("isc-grant", "isc", texts.ISC.partition("\n\n")[0]),
    Template("zlib", "zlib", texts.ZLIB),
    Template("apache-2-notice", "apache", texts.APACHE_2_NOTICE),
    Template("apache-line", "apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-2-notice", "gpl", texts.GPL_2_NOTICE),
    Template("gpl-3-notice", "gpl", texts.GPL_3_NOTICE),
    Template("gpl-line", "gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl-notice", "lgpl", texts.LGPL_NOTICE),
    Template("agpl-notice", "agpl", texts.AGPL_NOTICE),
    Template("mpl-2-notice", "mpl", texts.MPL_2_NOTICE),
    Template("cc-by-line", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa-line", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("all-rights", "proprietary", "Copyright all rights reserved no part of this publication may be reproduced"),
)


def templates_from(folder: str, label: dict[str, str] | None = None) -> tuple[Template, ...]:
    """A template for each text file of a folder, by its name; label: file name without ending -> label."""
    files = sorted(Path(folder).glob("*.txt"))
    return tuple(Template(f.stem, (label or {}).get(f.stem, f.stem), f.read_text(errors="replace")) for f in files)


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, k: int = 3, phrase_k: int = 2, gap: int = 8, coverage: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, text_hash, n_words, spans (array of start, end, name, label, exact,
    covered: word positions, end exclusive, and the share of the template's k-grams found).

    k, phrase_k: words of a gram of notices and of phrases; gap: how far from a span's diagonal others
    may be to belong to it; coverage: the share of a notice's k-grams a span needs.
    """
    spark = docs.sparkSession
    t = spark.createDataFrame([(x.name, x.label, x.text, x.exact, phrase_k if x.exact else k) for x in templates], "name string, label string, text string, exact boolean, k int")
    t = t.select("name", "label", "exact", "k", ascii_words(F.col("text")).alias("_words"))
    t = t.select("*", (F.size("_words") - F.col("k") + 1).alias("grams"), F.size("_words").alias("length"))
    ks = sorted({k, phrase_k})
    t = t.where("grams > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("at"))
    gram = F.coalesce(*[F.when(F.col("k") == n, window_hash(F.col("_words"), F.col("at"), n)) for n in ks])
    t = t.select("name", "label", "exact", F.col("k").alias("_tk"), "grams", "length", "at", gram.alias("_h"), F.slice("_words", F.col("at") + 1, F.col("k")).alias("_win"))

    d = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), ascii_words(F.col(text)).alias("_words"))
    d = d.select("_doc", "_text", "_words", F.size("_words").alias("_n"), F.posexplode_outer("_words").alias("_pos", "_w")).drop("_w")
    grams = [F.struct(F.when(F.col("_pos") + n <= F.col("_n"), window_hash(F.col("_words"), F.col("_pos"), n)).alias("g"), F.lit(n).alias("k")) for n in ks]
    d = d.select("_doc", "_text", "_words", "_n", F.coalesce("_pos", F.lit(0)).alias("_pos"), F.explode(F.array(*grams)).alias("_s"))
    first = (F.col("_pos") == 0) & (F.col("_s.k") == ks[0])  # one row per document stays, found or not
    small = sum(len(x.text.split()) for x in templates) <= BROADCAST_POSITIONS
    own = F.slice("_words", F.col("_pos") + 1, F.col("_s.k"))
    if not small:  # what is shuffled is a position's own few words, not its text's
        d, own = d.withColumn("_own", own).drop("_words"), F.col("_own")
    j = d.join(F.broadcast(t) if small else t.hint("merge"), (F.col("_s.g") == F.col("_h")) & (F.col("_s.k") == F.col("_tk")), "left")
    j = j.withColumn("_hit", F.coalesce(own == F.col("_win"), F.lit(False))).where(F.col("_hit") | first)
    only = lambda c: F.when(F.col("_hit"), F.col(c))
    j = j.select("_doc", "_text", "_n", *[only(c).alias(c) for c in ("name", "label", "exact", "grams", "length", "at")], only("_pos").alias("pos"))
    votes = j.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("_doc", "_text", "name", "diagonal").agg(
        F.max("_n").alias("_n"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("grams").alias("grams"), F.first("length").alias("length"),
        F.count("name").alias("votes"), F.collect_set("at").alias("ats"), F.min("at").alias("at0"), F.max("at").alias("at1"))
    # Exact phrases stand alone on their diagonal; a notice's span is a diagonal of most votes within reach.
    own = Window.partitionBy("_doc", "_text", "name").orderBy("diagonal")
    reach = own.rangeBetween(-gap, gap)
    votes = votes.withColumn("score", F.sum("votes").over(reach))
    # Of equally good ones the diagonal of most votes of its own, then the first, so that each span comes once.
    rank = F.struct((-F.col("score")).alias("s"), (-F.col("votes")).alias("v"), F.col("diagonal").alias("d"))
    votes = votes.withColumns({"peak": F.col("exact") | (F.min(rank).over(reach) == rank)})
    gathered = F.collect_list(F.struct("ats", (F.col("diagonal") + F.col("at0")).alias("a"), (F.col("diagonal") + F.col("at1")).alias("b"))).over(reach)
    alone = F.array(F.struct("ats", (F.col("diagonal") + F.col("at0")).alias("a"), (F.col("diagonal") + F.col("at1")).alias("b")))
    votes = votes.withColumn("parts", F.when(F.col("exact"), alone).otherwise(gathered)).where(F.col("peak") | F.col("name").isNull())
    spans = votes.select("_doc", "_text", "name", "_n", "label", "exact", "grams", F.array_min("parts.a").alias("start"), F.array_max("parts.b").alias("last"), F.size(F.array_distinct(F.flatten("parts.ats"))).alias("found"))
    covered = F.col("found") / F.col("grams")
    good = F.col("name").isNotNull() & F.when(F.col("exact"), F.col("found") == F.col("grams")).otherwise(covered >= coverage)
    width = F.when(F.col("exact"), F.lit(phrase_k)).otherwise(F.lit(k))
    row = F.struct(F.col("start").cast("long").alias("start"), (F.col("last") + width).cast("long").alias("end"), "name", "label", "exact", covered.alias("covered"))
    out = spans.groupBy("_doc", "_text").agg(F.max("_n").cast("long").alias("n_words"), F.array_sort(F.collect_list(F.when(good, row))).alias("spans"))
    return out.select(F.col("_doc").alias(doc_id), F.col("_text").alias("text_hash"), "n_words", "spans")
