"""How far the sources of a language differ in their words, by three-dimensional cube partitioning.

Terms are runs of ASCII letters and of characters from U+0080 on, A-Z lower-cased. A
language keeps the terms found in at least ``least_docs`` of its documents. A group is a
(lang, source) that occurs, with or without terms. With ``n`` occurrences of a kept term
in a group, ``total`` occurrences of all kept terms there and V kept terms, the smoothed
share is p = 1 + floor(10^9 * (n + 5) / (total + 5 * V)), in whole numbers throughout.

``pair_divergences`` sums abs(p_a - p_b) over all kept terms for every two groups of a
language. The work is a cube: groups are dealt into blocks, terms into blocks, and a task
owns cells (group block, group block, term block). The slice (group block, term block)
is replicated along one group axis, once per cell that needs it. A cell turns its two
slices into dense arrays of bounded size and returns one partial sum for each pair, and
the partial sums are added along the term axis. So neither a group with many terms nor a
language with many sources is ever gathered in one task.

``characteristic_terms`` lists the terms a source uses more than its language does.

Null text, lang and source are read as empty strings. Repeated rows count as often as
they occur. No documents give no rows; a language without kept terms has pairs of
divergence 0 and no term rows. Ties are ordered by the item's UTF-8 bytes. Other columns
of the documents are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationlens.session import written

#: Shares are whole billionths.
UNIT = 1_000_000_000
#: Added to the count of every kept term.
ADDED = 5
_COUNTS = "lang string, source string, term string, n long, docs long"
#: Entries a task holds before it passes its counts on, and bytes of one text cut at once.
_ENTRIES = 400_000
_CUT = 4 << 20


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between two terms."""
    at = 0
    while len(text) - at > _CUT:
        end = text.find(b" ", at + _CUT)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within each task.

    A task may return a term several times; its sums are what counts.
    """
    # Separators become blanks, A-Z become a-z; bytes from 0x80 on are parts of characters and stay.
    fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

    def batch_of(occurrences: dict, documents: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            seen = documents[lang, source]
            rows = len(counts)
            if rows:
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), terms,
                        pa.array(list(counts.values()), pa.int64()), pa.array([seen[t] for t in counts], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict = {}
        documents: dict = {}
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for group, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), texts):
                counts = occurrences.setdefault(group, Counter())
                seen = documents.setdefault(group, Counter())
                own: set = set()
                for piece in _pieces(text.translate(fold)):
                    terms = piece.split()
                    counts.update(terms)
                    own.update(terms)
                seen.update(own)
            if sum(map(len, occurrences.values())) > _ENTRIES:
                yield from batch_of(occurrences, documents)
                occurrences, documents = {}, {}
        yield from batch_of(occurrences, documents)

    return docs.select("lang", "source", "text").mapInArrow(task, _COUNTS)


def kept_terms(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """(lang, term, source, n) of the terms in at least ``least_docs`` documents of their language.

    The rows of a term are at most one for each source and flush of a task.
    """
    dealt = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(W.partitionBy("lang", "term"))
    return dealt.withColumn("in_lang", in_lang).filter(F.col("in_lang") >= least_docs).select("lang", "term", "source", "n")


def share(n: Column, whole: Column) -> Column:
    """1 + floor(UNIT * n / whole) by long division to the base 1000, exact up to 9 * 10^15."""
    whole = F.greatest(whole, F.lit(1))
    quotient = lambda x: F.call_function("div", x, whole)
    part, rest = quotient(n), n % whole
    for _ in range(3):
        part, rest = part * 1000 + quotient(rest * 1000), (rest * 1000) % whole
    return part + 1


class Shares:
    """The written tables all results are made of.

    ``groups``: lang, source, n (occurrences of kept terms), v (kept terms of the language), whole.
    ``shares``: lang, term, source, n, p for the terms a group holds.
    """

    def __init__(self, docs: DataFrame, least_docs: int = 30):
        text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
        docs = docs.select(text("lang"), text("source"), text("text"))
        kept = written(kept_terms(term_counts(docs), least_docs), "divergence-kept")
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
        groups = (
            docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
            .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
        )
        self.groups = written(groups.withColumn("whole", F.expr(f"n + {ADDED} * v")), "divergence-groups")
        # A source may hold a third of all terms; a small side is broadcast, else skewed parts are split by AQE.
        joined = kept.join(self.groups.select("lang", "source", "whole"), ["lang", "source"])
        p = share(F.col("n") + ADDED, F.col("whole")).alias("p")
        self.shares = written(joined.select("lang", "term", "source", "n", p), "divergence-shares")


def pair_divergences(shares: Shares, block_groups: int = 32, block_terms: int = 4096) -> DataFrame:
    """(lang, a, b, value) for every two sources a < b of a language."""
    groups = shares.groups.withColumn("p0", share(F.lit(ADDED).cast("long"), F.col("whole")))
    langs = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / block_groups).cast("int").alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.max("v") / block_terms)).cast("int").alias("term_blocks"),
    )
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    # The place of each term in its block; a block has about `block_terms` terms.
    block = W.partitionBy("lang", "term_block")
    terms = shares.shares.select("lang", "term").distinct().join(langs, "lang").withColumn("term_block", deal("term", "term_blocks"))
    placed = written(
        terms.select("lang", "term", "term_block", (F.row_number().over(block.orderBy("term")) - 1).alias("place")), "divergence-places"
    )
    width = placed.groupBy("lang", "term_block").agg(F.count("*").cast("int").alias("width"))
    held = (
        shares.shares.join(placed, ["lang", "term"]).groupBy("lang", "source", "term_block")
        .agg(F.collect_list("place").alias("places"), F.collect_list("p").alias("ps"))
    )
    slices = (
        groups.join(langs, "lang").withColumn("group_block", deal("source", "group_blocks"))
        .withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
        .join(width, ["lang", "term_block"], "left").join(held, ["lang", "source", "term_block"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    )
    cells = slices.selectExpr(
        "lang", "least(group_block, other) as i", "greatest(group_block, other) as j", "term_block as k",
        "group_block", "source", "p0", "coalesce(width, 0) as width", "places", "ps",
    )

    def cell(table: pa.Table) -> pa.Table:
        """Partial sums of all pairs of one cell."""
        table = table.sort_by("source").combine_chunks()
        names, block = table.column("source").to_pylist(), table.column("group_block").to_numpy()
        p0, size = table.column("p0").to_numpy(), int(table.column("width")[0].as_py())
        dense = np.repeat(p0[:, None], size, axis=1)
        for row, (places, ps) in enumerate(zip(table.column("places"), table.column("ps"))):
            if places.is_valid:
                dense[row, places.values.to_numpy()] = ps.values.to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right, sums = [], [], []
        for a in range(len(names)):
            later = np.arange(a + 1, len(names))
            others = later if i == j else later[block[later] != block[a]]
            if len(others):
                sums.append(np.abs(dense[others] - dense[a]).sum(axis=1, dtype=np.int64))
                left += [names[a]] * len(others)
                right += [names[b] for b in others.tolist()]
        value = np.concatenate(sums) if sums else np.zeros(0, np.int64)
        lang = pa.array([table.column("lang")[0].as_py()] * len(left), pa.string())
        return pa.table({"lang": lang, "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": value})

    partial = cells.groupBy("lang", "i", "j", "k").applyInArrow(cell, "lang string, a string, b string, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def characteristic_terms(shares: Shares) -> DataFrame:
    """(lang, source, term, value): terms whose share in the source exceeds that in the language, and by how much."""
    lang_whole = shares.groups.groupBy("lang").agg((F.sum("n") + ADDED * F.max("v")).alias("lang_whole"))
    in_lang = shares.shares.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(lang_whole, "lang")
    q = in_lang.select("lang", "term", share(F.col("lang_n") + ADDED, F.col("lang_whole")).alias("q"))
    return shares.shares.join(q, ["lang", "term"]).filter("p > q").selectExpr("lang", "source", "term", "p - q as value")


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50, block_groups: int = 32, block_terms: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by divergence, and the ``top_terms`` terms of each source."""
    shares = Shares(docs, least_docs)
    pairs = written(pair_divergences(shares, block_groups, block_terms), "divergence-pairs")
    both = pairs.selectExpr("lang", "a as source", "'pair' as part", "b as item", "value").unionByName(
        pairs.selectExpr("lang", "b as source", "'pair' as part", "a as item", "value")
    )
    terms = characteristic_terms(shares).selectExpr("lang", "source", "'term' as part", "term as item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = both.select("*", rank)
    return ranked.unionByName(terms.select("*", rank).filter(F.col("rank") <= top_terms))


def oracle(least_docs: int = 30, top_terms: int = 50) -> str:
    """The same rows in DuckDB."""
    return rf"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
words as (
  select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct row_id) >= {least_docs}),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
groups as (
  select g.lang, g.source, coalesce(c.n, 0) as n, coalesce(v.v, 0) as v
  from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n) as n from counts group by all) c using (lang, source)
  left join (select lang, count(*) as v from kept group by lang) v using (lang)),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + {ADDED})) // (g.n + {ADDED} * g.v) as p
  from groups g join kept k using (lang) left join counts c using (lang, source, term)),
langs as (
  select k.lang, k.term, 1 + ({UNIT}::hugeint * (sum(c.n) + {ADDED})) // (t.n + {ADDED} * t.v) as q
  from kept k join counts c using (lang, term) join (select lang, sum(n) as n, max(v) as v from groups group by lang) t using (lang)
  group by k.lang, k.term, t.n, t.v),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as value
    from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) d on d.lang = a.lang and d.source = a.source and d.other = b.source),
terms as (
  select s.lang, s.source, 'term' as part, s.term as item, s.p - l.q as value
  from shares s join langs l using (lang, term) where s.n > 0 and s.p > l.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {top_terms}
"""
