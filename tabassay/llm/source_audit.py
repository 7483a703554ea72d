"""How the sources of a language differ in their words, with strings joined back late.

Texts are counted once per task into (language, source, term) rows that stay where
they are, as files. From there only digests of the terms are shuffled: 64 bits
each, beside a 64-bit number for the group and two counts. Strings of terms that are kept
are gathered once per task and term, their smallest and largest per digest: where
the two differ, terms share a digest, and the rows of that digest alone are counted
again by their strings. At the end strings are joined to the rows of the result.

The divergence of two sources is a sum over all kept terms. Terms that neither has
add the same amount each, so only the terms of the two are looked at, the rest is a
product. Sources are paired in blocks and terms in buckets, so a task holds a bounded
matrix however many sources or terms a language has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm.shared import discard, map_batches, ship_package, slices, written

#: Documents of its language that a term must be in, and terms listed per group.
LEAST_DOCS = 10
TOP = 10
#: Probabilities are in parts of so much.
UNIT = 1_000_000_000
#: Counted (group, term) entries a task holds before it writes them out.
HELD = 1_000_000
#: Sources of a block and kept terms of a bucket in the sums over pairs.
BLOCK = 64
BUCKET = 512
#: Groups of (lang, source) up to which their numbers are broadcast.
FEW_GROUPS = 50_000
#: Digests of kept terms up to which they are broadcast.
FEW_TERMS = 1_000_000

#: Letters stay, A to Z in lower case, as do all bytes of other characters; the rest separates.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _count_terms(most: int) -> Callable:
    """Occurrences of terms and documents with them per group, written out at `most` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[int, tuple[Counter, Counter]] = {}

        def out() -> Iterator[dict]:
            for group, (n, docs) in counts.items():
                yield {
                    "grp": np.full(len(n), group, np.int64),
                    "term": pa.array(list(n), pa.binary()).cast(pa.string()),
                    "n": list(n.values()),
                    "docs": list(map(docs.__getitem__, n)),
                }
            counts.clear()

        held = 0
        for rows, texts in slices(batches, "text"):
            for group, text in zip(rows.column("grp").to_pylist(), texts, strict=True):
                words = text.translate(_LETTERS).split()
                if group not in counts:
                    counts[group] = (Counter(), Counter())
                n, docs = counts[group]
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
            if held >= most:
                yield from out()
                held = 0
        yield from out()

    return run


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    return _div((p - q) * (p - q), p + q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), in decimals, so that no count is too large."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + _div(wide, (total + 2 * terms).cast("decimal(20,0)"))


def audit(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and terms that mark a source.

    NULL language, source or text counts as empty. Repeated rows are rows of their own,
    and rows need no id. A language without kept terms has its pairs with value 0 and no
    terms; an empty table has no rows. Ties are ranked by the item's UTF-8 bytes.
    """
    narrow = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(text).alias("text"),
    )
    groups, number = _groups(narrow)
    few = groups.count() <= FEW_GROUPS
    counted = map_batches(
        narrow.select(number, "text"), _count_terms(HELD), "grp long, term string, n long, docs long"
    )
    stored = written(counted, "audit-parts")
    parts = stored.withColumn("digest", digest(F.col("term")).cast("long"))
    tongues = groups.select("grp", "tongue")
    tongues = F.broadcast(tongues) if few else tongues

    # The main shuffle: a number for the group, a digest, two counts.
    counts = written(
        parts.groupBy("grp", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .join(tongues, "grp").withColumn("twin", F.lit(0)),
        "audit-counts",
    )
    likely = written(
        counts.groupBy("tongue", "digest").agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= LEAST_DOCS).select("digest").distinct(),
        "audit-likely",
    )
    texts = parts.select("digest", "term")
    some = likely.count() <= FEW_TERMS
    if some:  # strings of other terms stay where they are
        texts = texts.join(F.broadcast(likely), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last"))
    texts = written(texts if some else texts.join(likely, "digest", "left_semi"), "audit-texts")
    early, late = [stored, counts, likely], [texts]
    names = texts.filter("term = last").select("digest", F.lit(0).alias("twin"), "term")
    shared = texts.filter("term <> last").select("digest")
    if not shared.isEmpty():
        # Terms that share a digest are told apart by a number each, and only they are counted again.
        torn = parts.join(shared, "digest", "left_semi").select("digest", "term").distinct()
        by_term = Window.partitionBy("digest").orderBy("term")
        twins = written(torn.withColumn("twin", F.row_number().over(by_term)), "audit-twins")
        again = (
            parts.join(twins, ["digest", "term"]).groupBy("grp", "digest", "twin")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(tongues, "grp")
        )
        counts = written(
            counts.join(shared, "digest", "left_anti").unionByName(again.select(*counts.columns)), "audit-split"
        )
        names = names.unionByName(twins.select("digest", "twin", "term"))
        early.append(counts)
        late.append(twins)

    kept = written(
        counts.groupBy("tongue", "digest", "twin").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= LEAST_DOCS).drop("docs"),
        "audit-kept",
    )
    used = written(counts.join(kept, ["tongue", "digest", "twin"]).drop("docs"), "audit-used")
    discard(*early)
    totals = written(_totals(groups, kept, used), "audit-totals")
    result = _pairs(totals, used, few).unionByName(_terms(totals, used, names, few))
    result = written(result.select("lang", "source", "part", "item", "value", "rank"), "audit")
    discard(*late, kept, used, totals, groups)
    return result


def _groups(narrow: DataFrame) -> tuple[DataFrame, Column]:
    """(lang, source, grp, tongue), and the column that gives a row the number of its group.

    Numbers are hashes, of which no two are equal: with another seed if need be.
    """
    seed = 0
    while True:
        number = F.xxhash64(F.lit(seed), "lang", "source").alias("grp")
        tongue = F.xxhash64(F.lit(seed), "lang").alias("tongue")
        groups = written(narrow.select("lang", "source").distinct().select("*", number, tongue), "audit-groups")
        clash = [
            groups.groupBy(key).agg(F.count_distinct(of).alias("n")).filter("n > 1")
            for key, of in (("grp", F.struct("lang", "source")), ("tongue", F.col("lang")))
        ]
        if clash[0].isEmpty() and clash[1].isEmpty():
            return groups, number
        discard(groups)
        seed += 1


def _totals(groups: DataFrame, kept: DataFrame, used: DataFrame) -> DataFrame:
    """Per group: its number among those of the language, occurrences of kept terms in both, and how many terms."""
    by_lang = kept.groupBy("tongue").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    by_group = used.groupBy("grp").agg(F.sum("n").alias("total"))
    place = Window.partitionBy("tongue").orderBy("source")
    filled = groups.join(by_group, "grp", "left").join(by_lang, "tongue", "left").fillna(
        0, ["total", "lang_total", "terms"]
    )
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    return filled.withColumns({
        "place": F.row_number().over(place) - 1,
        "sources": F.count("*").over(Window.partitionBy("tongue")),
        "none": none,
    })


def _pair_sums(size: int) -> Callable:
    """For sources of two blocks of `size` and the terms of one bucket: what the terms add beyond absent ones."""

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        tongue, first, second, _ = (x.as_py() for x in key)
        own, where = np.unique(table.column("place").to_numpy(), return_inverse=True)
        none = np.zeros(len(own), np.int64)
        none[where] = table.column("none").to_numpy()
        has = table.column("share").is_valid().to_numpy()
        names = np.stack([table.column("digest").to_numpy()[has], table.column("twin").to_numpy()[has]], axis=1)
        terms, row = np.unique(names, axis=0, return_inverse=True)
        matrix = np.tile(none, (len(terms), 1))
        matrix[row.ravel(), where[has]] = table.column("share").fill_null(0).to_numpy()[has]
        columns = [np.zeros((3, 0), np.int64)]
        block = own // size
        for a in np.flatnonzero(block == first):
            others = np.flatnonzero((block == second) & (own > own[a]))
            p, q = matrix[:, a : a + 1], matrix[:, others]
            gap, base = p - q, none[a] - none[others]
            beyond = (gap * gap // (p + q)).sum(axis=0) - len(terms) * (base * base // (none[a] + none[others]))
            columns.append(np.stack([np.full(len(others), own[a]), own[others], beyond]))
        a, b, beyond = np.concatenate(columns, axis=1).astype(np.int64)
        return pa.table({"tongue": np.full(len(a), tongue, np.int64), "a": a, "b": b, "sums": beyond})

    return sums


def _pairs(totals: DataFrame, used: DataFrame, few: bool) -> DataFrame:
    """Every other source of a group's language, most different first."""
    ship_package(totals.sparkSession)
    known = totals.select("grp", "tongue", "place", "sources", "none", "total", "terms")
    hint = F.broadcast(known.drop("tongue")) if few else known.drop("tongue")
    buckets = F.greatest(F.ceil(F.col("terms") / BUCKET), F.lit(1)).cast("long")
    present = used.join(hint, "grp").select(
        "tongue", "place", "sources", "none", "digest", "twin",
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("share"),
        F.pmod(F.xxhash64("digest"), buckets).alias("bucket"),
    )
    # One row without a term per source and bucket brings in the sources that have none of its terms.
    marks = known.select(
        "tongue", "place", "sources", "none", F.lit(0).cast("long").alias("digest"), F.lit(0).alias("twin"),
        F.lit(None).cast("long").alias("share"),
        F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket"),
    )
    mine = F.floor(F.col("place") / BLOCK)
    spread = (
        present.unionByName(marks)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / BLOCK))))
        .withColumns({"first": F.least(mine, F.col("other")), "second": F.greatest(mine, F.col("other"))})
        .select("tongue", "first", "second", "bucket", "place", "none", "digest", "twin", "share")
    )
    sums = spread.groupBy("tongue", "first", "second", "bucket").applyInArrow(
        _pair_sums(BLOCK), "tongue long, a long, b long, sums long"
    )
    whole = sums.groupBy("tongue", "a", "b").agg(F.sum("sums").alias("sums"))
    both = whole.unionByName(whole.select("tongue", F.col("b").alias("a"), F.col("a").alias("b"), "sums"))
    own = totals.select("tongue", F.col("place").alias("a"), "lang", "source", "terms", F.col("none").alias("p"))
    its = totals.select("tongue", F.col("place").alias("b"), F.col("source").alias("item"), F.col("none").alias("q"))
    wide = both.join(own, ["tongue", "a"]).join(its, ["tongue", "b"])
    valued = wide.withColumn("value", F.col("sums") + F.col("terms") * _divergence(F.col("p"), F.col("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _terms(totals: DataFrame, used: DataFrame, names: DataFrame, few: bool) -> DataFrame:
    """The terms of a group that are more frequent there than in its language, most telling first."""
    known = totals.select("grp", "lang", "source", "total", "lang_total", "terms")
    wide = used.join(F.broadcast(known) if few else known, "grp").filter("n > 0")
    shares = wide.withColumns({
        "p": _share(F.col("n"), F.col("total"), F.col("terms")),
        "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
    }).filter("p > q")
    valued = shares.withColumn("value", _divergence(F.col("p"), F.col("q")))
    # Ties at the last rank stay until their strings decide.
    by_value = Window.partitionBy("grp").orderBy(F.desc("value"))
    best = valued.withColumn("rank", F.rank().over(by_value)).filter(F.col("rank") <= TOP)
    listed = best.select("grp", "lang", "source", "digest", "twin", "value").join(names, ["digest", "twin"])
    order = Window.partitionBy("grp").orderBy(F.desc("value"), "term")
    ranked = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
