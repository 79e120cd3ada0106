"""Audit of how far sources of a language differ in the terms they use.

A language keeps the terms of at least ``LEAST_DOCS`` of its documents. They are
found by iceberg refinement of byte prefixes: of a term (with an end mark) first
two bytes are looked at, then four, eight and so on; a prefix whose number of
documents in the language falls below the bound is discarded with all terms
below it, until only whole terms are left. A task tells the documents of each
prefix apart once, in sorted arrays, and sends one row per term that it has met:
the numbers of documents of the prefixes that begin with this term, and its
occurrences by source. So levels are plain joins and sums over rows that get
fewer, and a common prefix costs a row per task.

Terms are then compared in blocks of terms by tiles of sources; a block sums the
differences of its tile's sources. All arithmetic is exact.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerscan.llm.resampling import PIECE as STRETCH
from layerscan.llm.words import text_bytes
from layerscan.session import materialize

LEAST_DOCS = 30
TOP = 50
#: Fixed by the contract: probabilities are in these units, counts have this added.
UNIT, ADDED = 1_000_000_000, 5
#: Text bytes that a task gathers before it sends their terms.
PIECE = 32 << 20
#: Sources of a tile, and terms of a block.
TILE, TERMS = 256, 4096

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


class _Gathered:
    """Terms of documents of one language: per document its distinct terms and their counts."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.source, self.terms, self.times = [], [], []

    def add(self, source: str, text: bytes, number=count) -> None:
        text, at, seen = text.translate(_TABLE), 0, []
        while at < len(text):
            end = len(text) if len(text) - at <= STRETCH else text.find(b" ", at + STRETCH)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            names = self.names
            seen.append(np.array([names.setdefault(w, len(names)) for w in words], np.int32))
            at = end
        found, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.int32),) * 2
        self.source.append(self.sources.setdefault(source, len(self.sources)))
        self.terms.append(found)
        self.times.append(times)

    def rows(self, lang: str) -> pa.RecordBatch:
        """A row per term: documents of the prefixes that it begins, occurrences by source."""
        names = np.array(list(self.names), object)
        order = np.argsort(names, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = [names[i] + b"\0" for i in order]
        sizes = np.array([len(x) for x in names])
        doc = np.repeat(np.arange(len(self.terms)), [len(x) for x in self.terms])
        term, times = rank[np.concatenate(self.terms)], np.concatenate(self.times)
        source = np.array(self.source)[doc]
        by_doc = np.lexsort((term, doc))
        d, t = doc[by_doc], term[by_doc]
        levels, length = [], 2
        while True:
            # Terms are sorted, so those of one prefix are neighbours, in a document too.
            heads = [x[:length] for x in names]
            begins = np.r_[True, np.array([x != y for x, y in zip(heads[1:], heads)], bool)]
            prefix = np.cumsum(begins) - 1
            p = prefix[t]
            new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]
            docs = np.zeros(len(names), np.int64)
            docs[np.flatnonzero(begins)] = np.bincount(p[new], minlength=prefix[-1] + 1)
            levels.append(docs)
            if length >= sizes.max():
                break
            length *= 2
        # A term needs no level beyond the first that holds it whole.
        depth = np.maximum(1, np.ceil(np.log2(sizes)).astype(np.int64))
        ends = np.r_[0, np.cumsum(depth)]
        level = np.arange(ends[-1]) - np.repeat(ends[:-1], depth)
        flat = np.stack(levels)[level, np.repeat(np.arange(len(names)), depth)]
        pair = term * len(self.sources) + source
        order = np.argsort(pair, kind="stable")
        new = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
        total = np.add.reduceat(times[order], new)
        pair = pair[order][new]
        cuts = np.searchsorted(pair // len(self.sources), np.arange(len(names) + 1))
        entries = pa.StructArray.from_arrays(
            [pa.array(list(self.sources), pa.string()).take(pa.array(pair % len(self.sources))), pa.array(total, pa.int64())],
            names=["source", "n"],
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(names), pa.string()),
                pa.array([x[:-1] for x in names], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries),
            ],
            names=["lang", "term", "docs", "sources"],
        )


def _local_terms(batches):
    held: dict[str, _Gathered] = {}
    size = 0
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            held.setdefault(langs[i], _Gathered()).add(sources[i], data[a:b].tobytes())
            size += b - a
            if size >= PIECE:
                yield from (x.rows(lang) for lang, x in held.items() if x.names)
                held, size = {}, 0
    yield from (x.rows(lang) for lang, x in held.items() if x.names)


def local_terms(docs: DataFrame) -> DataFrame:
    """Terms of ``lang``, ``source`` and ``text``, a row per task, language and term.

    ``docs`` counts, for prefixes of 2, 4, 8 ... bytes of the term with its end
    mark, the documents of prefixes that this is the first term of, else 0.
    """
    schema = "lang string, term string, docs array<long>, sources array<struct<source string, n long>>"
    return docs.select("lang", "source", "text").mapInArrow(_local_terms, schema)


def kept_terms(local: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang`` and ``term`` of all terms in at least ``least_docs`` documents of the language."""
    rows = local.select("lang", "term", "docs", F.concat(F.encode("term", "utf-8"), F.lit(b"\0")).alias("whole"))
    kept, level, length = None, 0, 2
    while True:
        prefix = F.substring("whole", 1, length)
        alive = materialize(
            rows.select("lang", prefix.alias("prefix"), F.col("docs")[level].alias("n"))
            .groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "prefix"),
            "prefixes",
        )
        is_whole = F.substring("prefix", -1, 1) == F.lit(b"\0")
        whole = alive.where(is_whole).select(
            "lang", F.decode(F.expr("substring(prefix, 1, octet_length(prefix) - 1)"), "utf-8").alias("term")
        )
        kept = whole if kept is None else kept.union(whole)
        open_prefixes = alive.where(~is_whole)
        if open_prefixes.isEmpty():
            return kept
        rows = materialize(
            rows.withColumn("prefix", prefix).join(open_prefixes, ["lang", "prefix"], "left_semi").drop("prefix"), "terms"
        )
        level, length = level + 1, length * 2


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * terms)), exact beyond 64 bits."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    return F.call_function("div", above, (total + F.lit(ADDED) * terms).cast("decimal(20,0)")).cast("long") + 1


def _differences(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Summed differences of the pairs of a tile over a block of terms.

    What differs for terms that neither source has is left out here, but for
    block 0, which adds it for every kept term of the language.
    """
    lang, low, high, block = (k.as_py() for k in key)
    groups = groups.sort_by("source")
    names = groups["source"].to_pylist()
    tile, base = groups["tile"].to_numpy(), groups["base"].to_numpy()
    at = {name: i for i, name in enumerate(names)}
    of = np.array([at[x] for x in counts["source"].to_pylist()], np.int64)
    terms = counts["term"].dictionary_encode().combine_chunks()
    terms = terms if isinstance(terms, pa.DictionaryArray) else pa.array([], pa.string()).dictionary_encode()
    share = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    share[of, terms.indices.to_numpy(zero_copy_only=False)] = counts["p"].to_numpy()
    first, second, value = [], [], []
    for i in np.flatnonzero(tile == low):
        other = np.flatnonzero(tile == high)
        other = other[other > i] if low == high else other
        start = np.abs(base[other] - base[i])
        sums = np.abs(share[other] - share[i]).sum(axis=1) - start * share.shape[1]
        if block == 0:
            sums += start * groups["terms"][0].as_py()
        first += [names[i]] * len(other)
        second += [names[j] for j in other]
        value += sums.tolist()
    return pa.table(
        {
            "lang": pa.array([lang] * len(first), pa.string()), "one": pa.array(first, pa.string()),
            "two": pa.array(second, pa.string()), "value": pa.array(value, pa.int64()),
        }
    )


def pair_differences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``one``, ``two`` and ``value``: summed differences of each pair of sources of a language.

    ``shares`` has the shares ``p`` of the terms that a source has, ``groups`` the share
    ``base`` of one that it has not and the number ``terms`` of kept terms.
    """
    sizes = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("tiles"),
        F.greatest(F.lit(1), F.ceil(F.max("terms") / TERMS)).cast("int").alias("blocks"),
    )
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    tiles = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    keys = ("lang", "low", "high", "block")
    ends = (F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    left = (
        shares.join(sizes, "lang").withColumn("tile", tile)
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        .select("lang", "block", "tile", "source", "term", "p", tiles)
        .select(*ends, "lang", "block", "source", "term", "p")
    )
    right = (
        groups.join(sizes, "lang").withColumn("tile", tile)
        .select("lang", "tile", "blocks", "source", "base", "terms", tiles)
        .select(*ends, "lang", "tile", "source", "base", "terms", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _differences, "lang string, one string, two string, value long"
    )
    return parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """How sources differ: ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair`` has a row for each other source of the language, part ``term``
    the ``top`` terms that the source uses most above its language. Null texts,
    languages and sources count as empty ones; every row of ``docs`` is a document of
    its own, repeated or not, and other columns are not read. A language without
    kept terms has pairs of value 0; ties are ranked by item; no rows, no result.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    local = materialize(local_terms(docs), "local-terms")
    kept = materialize(kept_terms(local, least_docs), "kept-terms")
    counts = materialize(
        local.select("lang", "term", "sources").join(kept, ["lang", "term"]).select("lang", "term", F.inline("sources"))
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n")),
        "counts",
    )
    in_lang = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "lang-counts")
    langs = in_lang.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("lang_total"), zero("terms"))
    base = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    groups = materialize(groups.withColumn("base", base), "groups")
    shares = materialize(
        counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
        .select("lang", "source", "term", "p", "lang_total", "terms"),
        "shares",
    )
    pairs = pair_differences(shares.select("lang", "source", "term", "p"), groups.select("lang", "source", "base", "terms"))
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    pairs = pairs.select("lang", "value", F.explode(F.array(way("one", "two"), way("two", "one"))).alias("way"))
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    above = (
        shares.join(in_lang, ["lang", "term"]).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    place = F.row_number().over(order).alias("rank")
    return pairs.select("*", place).unionByName(above.select("*", place).where(F.col("rank") <= top))


def divergence_report(docs: DataFrame) -> DataFrame:
    """``op12``: the audit of all documents."""
    return audit(docs)


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), langs AS (
  SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
    1 + (1000000000 * (k.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM found
)
SELECT * FROM placed WHERE part = 'pair' OR rank <= 50
"""
