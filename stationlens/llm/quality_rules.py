"""Quality rules with DataFrame functions only: base counts and robust outliers per group.

Words are runs of characters other than space and U+0009-U+000D. The base counts feed a
base rule (too few words, too many repeated ones). The documents that pass it form a
vector of statistics each. Per language and source a minimum-covariance-determinant
estimate of location and scatter is found by concentration steps; a document whose
squared Mahalanobis distance is beyond the limit is rejected.

How the estimate is made:

* The statistics are transformed to be roughly symmetric and rounded to units of
  1/1024, so all sums are sums of whole numbers and do not depend on their order.
* Two deterministic starts: a median-and-quartile box, and all rows of the group.
  From each, ``steps`` concentration steps: distances, then mean and scatter of the
  ``subset`` share of rows nearest to the centre. The start with the smaller
  determinant is taken, then one reweighting step at the 0.975 quantile.
* A step is one pass: rows are summed per (group, distance bin) before the shuffle, and
  the wanted share is read off the bins, so a group with a third of all rows is a few
  thousand bin rows. Bins are 1/8 of an octave wide; the subset takes whole bins.
* Scatter gets a ridge (``RIDGE``, a deviation of a tenth), so statistics that are zero
  for most documents do no harm.
* Every document that passes the base rule has a distance. Sources with fewer than
  ``min_group`` rows in a language share one estimate; where those together have fewer
  rows, that of all rows of the language serves, and where the language has fewer rows,
  that of all rows of all languages. Where even the table has fewer rows, a scale below
  one counts as one, so that a handful of equal rows does not reject all others.

Null or blank text has no words and fails the base rule. Null language or source are
values like any other. Repeated ids and rows give a row each, and so do rows without id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stationlens.operators.skew import lookup_join
from stationlens.session import written

# Fixed values of the base rules.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

UNIT = 1024.0
#: Name of the shared estimates, as source and as language.
REST, ALL = "\1rest", "\1all"
RIDGE = 102.0
BINS_PER_OCTAVE = 8
#: Quantiles of chi-squared with five degrees of freedom: 0.5, 0.975.
CHI_MEDIAN, CHI_REWEIGHT = 4.3515, 12.8325
#: Squared distance beyond which a document is rejected.
LIMIT = 50.0
KEYS = ("e_lang", "e_source")
STATS = ("length", "word_length", "symbols", "dup_lines", "repeats")
D = len(STATS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts (and ``_text`` replaced by them); columns of those names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in BASE]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split("_q_text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    first = docs.select(*kept, text.alias("_q_text")).withColumns(
        {
            "_q_words": F.filter(F.split("_q_text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != ""),
            "_q_lines": lines,
            "word_chars": F.length(F.translate("_q_text", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"),
        }
    )
    # A window is known by the hash of its eight words; positions of windows seen twice cover words.
    last = F.size("_q_words") - WINDOW
    windows = F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.col("_q_words")[i + k] for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_windows": windows,
        }
    ).drop("_q_text", "_q_words", "_q_lines")
    third = second.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
            F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    ).drop("_q_windows")
    same = lambda i, k: F.col("_q_sorted")[i]["h"] == F.col("_q_sorted")[k]["h"]
    end = F.size("_q_sorted") - 1
    repeated = F.filter(
        F.col("_q_sorted"),
        lambda x, i: F.when((i > 0) & same(F.greatest(i - 1, F.lit(0)), i), True)
        .when((i < end) & same(F.least(i + 1, end), i), True)
        .otherwise(False),
    )
    fourth = third.withColumn("_q_at", F.when(F.col("_q_sorted").isNotNull(), F.array_sort(F.transform(repeated, lambda x: x["p"])))).drop("_q_sorted")
    covered = F.aggregate(
        "_q_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("int").alias("p")),
        lambda a, p: F.struct((a["n"] + F.least(p - a["p"], F.lit(WINDOW))).alias("n"), p.alias("p")),
        lambda a: a["n"],
    )
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_q_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics in whole units."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [
        F.log(words) / 4,
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.col("n_symbols") / words,
        F.col("n_dup_lines") * WINDOW / words,
        F.col("n_repeat_words") / words,
    ]
    return [F.round(v * UNIT).alias(name) for v, name in zip(values, STATS)]


def _factor(params: DataFrame) -> DataFrame:
    """Adds the factor columns ``l{i}{j}`` and ``logdet`` to means ``m*`` and covariances ``c{i}{j}``."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(RIDGE))) if i == j else rest / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", value)
    return params.withColumn("logdet", sum((F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0)) * 2)


def _squared_distance(rows: DataFrame, stat: str, param: str) -> DataFrame:
    """Adds ``_q_d2``: the squared Mahalanobis distance of columns ``stat % name`` to ``param % name``."""
    for i in range(D):
        rest = F.col(stat % STATS[i]) - F.col(param % f"m{i}")
        for k in range(i):
            rest = rest - F.col(param % f"l{i}{k}") * F.col(f"_q_z{k}")
        rows = rows.withColumn(f"_q_z{i}", rest / F.col(param % f"l{i}{i}"))
    squared = sum((F.col(f"_q_z{i}") * F.col(f"_q_z{i}") for i in range(1, D)), F.col("_q_z0") * F.col("_q_z0"))
    return rows.withColumn("_q_d2", squared).drop(*[f"_q_z{i}" for i in range(D)])


def _with_distance(rows: DataFrame, params: DataFrame, n_params: int) -> DataFrame:
    used = [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in PAIRS]
    wanted = [*KEYS, *[c for c in ("start",) if c in params.columns], *used]
    joined = lookup_join(rows, params.select(*wanted), n_params, list(KEYS), list(STATS))
    return _squared_distance(joined, "%s", "%s").drop(*used)


def _bins(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums per distance bin, with ``upto`` (rows in this and nearer bins) and ``total``."""
    number = F.floor(F.log2(F.greatest("_q_d2", F.lit(2.0**-40))) * BINS_PER_OCTAVE).cast("int")
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in PAIRS]
    binned = measured.withColumn("bin", number).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    group = W.partitionBy(*keys)
    return binned.withColumns(
        {"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)}
    )


def _edge(column: str) -> Column:
    """The upper edge of a bin."""
    return F.pow(F.lit(2.0), (F.col(column) + 1) / F.lit(float(BINS_PER_OCTAVE)))


def _estimate(bins: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Mean, factor and determinant of the rows in the bins that are ``inside``."""
    chosen = bins.filter(inside).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(D)],
        *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in PAIRS],
    )
    params = chosen.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)}).withColumns(
        {
            f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (RIDGE * RIDGE if i == j else 0.0)
            for i, j in PAIRS
        }
    )
    return _factor(params)


def estimates(rows: DataFrame, n_groups: int, subset: float = 0.75, steps: int = 4) -> DataFrame:
    """Robust location and scatter of each group of ``rows`` (columns KEYS and STATS), with their ``scale``.

    ``scale`` is the median squared distance over its value for normal data.
    """
    keys = [*KEYS, "start"]
    # Values are whole units in a narrow range, so the exact percentiles hold few values.
    quartiles = rows.groupBy(*KEYS).agg(*[F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"p{i}") for i, c in enumerate(STATS)])
    box = quartiles.select(
        *KEYS, F.lit(0).alias("start"),
        *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(D)],
        *[((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349 + RIDGE if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS],
    )
    everything = _estimate(
        rows.withColumn("_q_d2", F.lit(1.0)).transform(lambda r: _bins(r, list(KEYS))), list(KEYS), F.lit(True)
    ).withColumn("start", F.lit(1))
    params = written(box.unionByName(everything.select(box.columns)), "mcd-start")
    for _ in range(steps):
        bins = _bins(_with_distance(rows, params, 2 * n_groups), keys)
        params = written(_estimate(bins, keys, F.col("upto") - F.col("n") < F.ceil(F.col("total") * subset)), "mcd-step")
    best = params.groupBy(*KEYS).agg(F.min(F.struct("logdet", "start", *[c for c in params.columns if c not in (*keys, "logdet")])).alias("b"))
    params = written(best.select(*KEYS, "b.*"), "mcd-best")
    for name in ("mcd-reweighted", "mcd-scaled"):
        bins = written(_bins(_with_distance(rows, params.drop("start"), n_groups), list(KEYS)), "mcd-bins")
        # The bin that holds the median row tells the scale.
        middle = bins.filter((F.col("upto") - F.col("n") < F.col("total") / 2) & (F.col("upto") >= F.col("total") / 2))
        scale = middle.select(*KEYS, (_edge("bin") / CHI_MEDIAN).alias("scale"))
        if name == "mcd-scaled":
            return written(params.join(scale, list(KEYS)), name)
        near = _edge("bin") <= CHI_REWEIGHT * F.col("scale")
        params = written(_estimate(bins.join(scale, list(KEYS)), list(KEYS), near), name)


def verdicts(
    counted: DataFrame,
    limit: float = LIMIT,
    subset: float = 0.75,
    steps: int = 4,
    min_group: int = 200,
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``counted`` (see ``base_counts``) with ``base_failed``, ``distance`` and ``kept``; columns of those names are replaced."""
    inner = counted.drop("base_failed", "distance", "kept", "_q_lang", "_q_source")
    names = inner.columns
    named = inner.withColumns(
        {
            "base_failed": base_failed(),
            "_q_lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("\0")),
            "_q_source": F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\0")),
        }
    )
    named = written(named.withColumns(dict(zip([f"_q_{s}" for s in STATS], transformed()))), "quality-counts")
    plain = named.filter(~F.col("base_failed")).select("_q_lang", "_q_source", *[F.col(f"_q_{s}").alias(s) for s in STATS])
    sizes = written(plain.groupBy("_q_lang", "_q_source").count(), "quality-groups")
    small = F.when(F.col("count") < min_group, F.col("count")).otherwise(0)
    langs = sizes.groupBy("_q_lang").agg(F.sum("count").alias("in_lang"), F.sum(small).alias("in_rest"))
    # The estimate a group is judged by, and those its rows are part of.
    own = F.col("count") >= min_group
    rest, whole = F.col("in_rest") >= min_group, F.col("in_lang") >= min_group
    named_as = lambda lang, source: F.struct(lang.alias("e_lang"), source.alias("e_source"))
    itself = named_as(F.col("_q_lang"), F.when(own, F.col("_q_source")).otherwise(F.lit(REST)))
    in_lang, in_all = named_as(F.col("_q_lang"), F.lit(ALL)), named_as(F.lit(ALL), F.lit(ALL))
    found = langs.agg(F.sum("in_lang").alias("n"), F.coalesce(F.bool_or(~whole), F.lit(False)).alias("b")).first()
    part_of = F.array(F.when(own | rest, itself), F.when((F.col("in_rest") > 0) & ~rest & whole, in_lang), F.when(F.lit(found["b"]), in_all))
    groups = written(
        sizes.join(langs, "_q_lang").select(
            "_q_lang", "_q_source", F.when(own | rest, itself).when(whole, in_lang).otherwise(in_all).alias("by"),
            F.filter(part_of, lambda e: e.isNotNull()).alias("part_of"),
        ),
        "quality-estimates",
    )
    n_groups = groups.count()
    rows = lookup_join(plain, groups.drop("by"), n_groups, ["_q_lang", "_q_source"], list(STATS))
    rows = rows.select(F.explode("part_of").alias("e"), *STATS).select("e.*", *STATS)
    # Each source has at most one estimate of its own; two per language and one more are shared.
    params = estimates(written(rows, "quality-rows"), 3 * n_groups + 1, subset, steps)
    if (found["n"] or 0) < min_group:
        params = params.withColumn("scale", F.greatest("scale", F.lit(1.0)))
    groups = groups.select("_q_lang", "_q_source", "by.*")
    fields = F.struct("scale", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])
    params = groups.join(params, list(KEYS)).select("_q_lang", "_q_source", fields.alias("_q_params"))
    spread = [f"_q_{s}" for s in STATS]
    measured = lookup_join(named, params, n_groups, ["_q_lang", "_q_source"], spread, "left")
    measured = _squared_distance(measured, "_q_%s", "_q_params.%s")
    distance = F.when(~F.col("base_failed"), F.col("_q_d2") / F.col("_q_params.scale"))
    kept = ~F.col("base_failed") & (distance <= limit)
    return measured.select(*[F.col(f"`{c}`") for c in names], "base_failed", distance.alias("distance"), kept.alias("kept"))
