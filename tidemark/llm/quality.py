"""Quality rules: text statistics, fixed limits and robust multivariate
outliers per language and source (DataFrame functions only).

Five statistics of a text, transformed to be roughly symmetric, form a vector.
For every (language, source) the minimum-covariance-determinant estimate of its
centre and scatter is searched by concentration steps from four deterministic
starts: keep the ``H`` share of documents nearest by Mahalanobis distance,
estimate anew from them, repeat until the determinant settles; the start with
the least determinant wins.  A document whose robust distance is above the
group's cutoff is rejected.

Each step is one aggregation over a narrow staged table, by bins of distance (a
few hundred a group), so no group is sorted or gathered.  Statistics are kept in
whole steps of 0.0001 and summed as decimals, hence reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, small, staged, words

#: Names of the vector's entries and the smallest spread that each is given.
VECTOR = {"x1": 0.3, "x2": 0.05, "x3": 0.05, "x4": 0.1, "x5": 0.1}
UNIT = 10_000  # steps to 1 in the stored vector
PRIOR = 20  # words of five letters added to each text's mean word length
H = 0.75  # share of documents that the estimate rests on
CHI5 = (2.6746, 4.3515, 6.6257)  # quartiles of chi-square with five degrees of freedom
MOST_GROUPS = 100_000  # groups (a row of some 30 numbers each) that are broadcast
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "cutoff", "kept")


def _doubled(h: Column, other: Column, d: int) -> Column:
    """The hash of ``h[i], other[i + d]`` for every i that has both."""
    n = F.size(other) - d
    return F.when(n >= 1, F.zip_with(F.slice(h, F.lit(1), n), F.slice(other, F.lit(1 + d), n), lambda a, b: F.xxhash64(a, b))).otherwise(
        F.array().cast("array<bigint>"))


def repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    def covered(at):
        steps = F.zip_with(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))),
                           lambda b, a: F.least(b - a, F.lit(5)))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(0), lambda s, x: s + x) + 5).otherwise(0)

    def repeated(h):
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda r: F.array_sort(F.transform(F.filter(
            F.transform(r, lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get(r, i - 1)["h"]) | (x["h"] == F.get(r, i + 1)["h"])).alias("two"))),
            lambda x: x["two"]), lambda x: x["i"])))

    fives = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(let(_doubled(h, h, 1), lambda t: _doubled(t, t, 2)), lambda q: _doubled(q, h, 4)))
    return let(fives, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(repeated(h), covered)).otherwise(0))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each text (see the contract of op5)."""
    text = F.col("text")
    white = r"[\x20\x09-\x0D]+"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, white, "")) > 0)
    counted = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).cast("long").alias("n_repeat_words")))
    found = docs.select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("version"), counted.alias("c"), F.coalesce(F.length(F.regexp_replace(text, white, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))),
                   F.struct(F.lit(0).alias("n"), F.lit(0).alias("d"))).alias("l"))
    return found.select("doc_id", "lang", "source", "version", "c.n_words", "word_chars", "n_symbols", F.col("l.d").cast("long").alias("n_dup_lines"), "c.n_repeat_words",
                        F.greatest(F.col("l.n"), F.lit(0)).cast("long").alias("n_lines"))


def _vector() -> dict[str, Column]:
    """The transformed statistics, in whole steps: logarithms of length and mean
    word length, square roots of the shares of symbols, repeated lines and
    repeated words.  The mean word length of a few words scatters widely, so it
    is drawn to five letters by ``PRIOR`` words of that length."""
    c = F.col
    share = lambda a, b: F.sqrt(c(a) / (c(b) + 1))
    exact = [F.log(c("n_words") + 1.0), F.log((c("word_chars") + 5 * PRIOR) / (c("n_words") + PRIOR)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return {k: F.floor(x * UNIT + 0.5).cast("long") for k, x in zip(VECTOR, exact, strict=True)}


def _pairs() -> list[tuple[str, str]]:
    names = list(VECTOR)
    return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]


def _per_group(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with their group's columns (``n_groups`` rows at most): a group that
    holds a third of all rows is no join key while there are at most ``MOST_GROUPS``."""
    return rows.join(F.broadcast(groups) if n_groups <= MOST_GROUPS else small(groups, MOST_GROUPS), "g")


def _middle(rows: DataFrame) -> DataFrame:
    """Per group: ``n``, medians ``m_*`` and spreads ``s_*`` (of the quartiles,
    raised to their least values), from histograms with steps of 0.01."""
    tall = rows.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(k) / 100).alias("bin")) for k in VECTOR])).alias("x")).select("g", "x.*")
    bins = tall.groupBy("g", "k", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "k").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "k")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) / 100))
    spread = bins.groupBy("g", "k").agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.5).alias("m"), at(0.75).alias("q3"))
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = spread.withColumn("s", (F.col("q3") - F.col("q1")) / 1.349)
    return wide.groupBy("g").agg(F.max("n").alias("n"), *[of(k, "m").alias(f"m_{k}") for k in VECTOR],
                                 *[F.greatest(of(k, "s"), F.lit(v)).alias(f"s_{k}") for k, v in VECTOR.items()])


def _starts(rows: DataFrame, middle: DataFrame, n_groups: int) -> DataFrame:
    """Per group and start ``s``: centre and scatter to begin with.  All begin
    at the medians, with the quartile spreads and a correlation of: nothing (0),
    hyperbolic tangents (1), signs (2), spatial signs (3) of the scaled rows."""
    z = {k: (F.col(k) / UNIT - F.col(f"m_{k}")) / F.col(f"s_{k}") for k in VECTOR}
    scaled = _per_group(rows, middle, n_groups).select("g", *[z[k].alias(k) for k in VECTOR])
    scaled = scaled.withColumn("r", F.sqrt(sum((F.col(k) * F.col(k) for k in VECTOR), F.lit(0.0))))
    forms = {1: lambda k: F.tanh(F.col(k)), 2: lambda k: F.signum(F.col(k)),
             3: lambda k: F.when(F.col("r") > 0, F.col(k) / F.col("r")).otherwise(0.0)}
    whole = lambda x: F.floor(x * UNIT * UNIT + 0.5).cast("decimal(18,0)")  # noqa: E731  sums do not hang on the order of rows
    sums = scaled.groupBy("g").agg(*[F.sum(whole(f(a) * f(b))).cast("double").alias(f"p{s}_{a}_{b}") for s, f in forms.items() for a, b in _pairs()])

    def scatter(s: int, a: str, b: str) -> Column:
        own = F.col(f"s_{a}") * F.col(f"s_{b}")
        if a == b:
            return own
        if s == 0:
            return F.lit(0.0)
        r = F.try_divide(F.col(f"p{s}_{a}_{b}"), F.sqrt(F.col(f"p{s}_{a}_{a}") * F.col(f"p{s}_{b}_{b}")))
        return own * F.coalesce(r, F.lit(0.0))

    each = [F.struct(F.lit(s).alias("s"), *[scatter(s, a, b).alias(f"c_{a}_{b}") for a, b in _pairs()]) for s in (0, *forms)]
    return middle.join(sums, "g").select("g", *[f"m_{k}" for k in VECTOR], F.explode(F.array(*each)).alias("e")).select("g", *[f"m_{k}" for k in VECTOR], "e.*")


def _inverse() -> list[dict[str, Column]]:
    """The inverse ``w_*`` of the scatter's Cholesky factor, so that the squared
    distance is a plain sum of squares, and ``logdet``, the logarithm of the
    scatter's determinant.  Variances are raised to their least values first,
    which keeps the scatter regular where a statistic is constant.  Columns of a
    layer need only those of layers before: each layer is one node of the plan."""
    names = list(VECTOR)
    cov = {(a, b): F.greatest(F.col(f"c_{a}_{b}"), F.lit(VECTOR[a] ** 2)) if a == b else F.col(f"c_{a}_{b}") for a, b in _pairs()}
    layers: list[dict[str, Column]] = []
    depth: dict[str, int] = {}

    def add(name: str, value: Column, *needs: str) -> None:
        depth[name] = max((depth[x] + 1 for x in needs), default=0)
        if depth[name] == len(layers):
            layers.append({})
        layers[depth[name]][name] = value

    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = cov[a, b] - sum((F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in names[:j]), F.lit(0.0))
            before = [f"l_{x}_{k}" for k in names[:j] for x in (a, b)]
            if a == b:
                add(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(VECTOR[a] ** 2 / 100))), *before)
            else:
                add(f"l_{a}_{b}", rest / F.col(f"l_{b}_{b}"), f"l_{b}_{b}", *before)
    for i, a in enumerate(names):
        add(f"w_{a}_{a}", 1 / F.col(f"l_{a}_{a}"), f"l_{a}_{a}")
        for j, b in enumerate(names[:i]):
            value = -sum((F.col(f"l_{a}_{k}") * F.col(f"w_{k}_{b}") for k in names[j:i]), F.lit(0.0)) / F.col(f"l_{a}_{a}")
            add(f"w_{a}_{b}", value, f"l_{a}_{a}", *[x for k in names[j:i] for x in (f"l_{a}_{k}", f"w_{k}_{b}")])
    add("logdet", sum((2 * F.log(F.col(f"l_{a}_{a}")) for a in names), F.lit(0.0)), *[f"l_{a}_{a}" for a in names])
    return layers


def _inverted(groups: DataFrame, inverse: list[dict[str, Column]]) -> DataFrame:
    """``groups`` with the columns of ``_inverse`` instead of their scatter."""
    for layer in inverse:
        groups = groups.withColumns(layer)
    return groups.drop(*[c for c in groups.columns if c[:2] in ("l_", "c_")])


def _distance() -> Column:
    """The squared Mahalanobis distance of a row joined with its group."""
    names = list(VECTOR)
    off = {k: F.col(k) / UNIT - F.col(f"m_{k}") for k in names}
    total = F.lit(0.0)
    for i, a in enumerate(names):
        z = sum((F.col(f"w_{a}_{b}") * off[b] for b in names[: i + 1]), F.lit(0.0))
        total = total + z * z
    return total


def _bin() -> Column:
    return F.floor(F.log1p("d") * 64).cast("int")


def _sums() -> tuple[list[Column], list[Column], list[Column]]:
    """What a concentration step adds up per bin, then over bins, and the centre and scatter from it."""
    names = list(VECTOR)
    dec = lambda c: c.cast("decimal(18,0)")
    parts = {"n": F.count(F.lit(1)), **{f"s_{a}": F.sum(dec(F.col(a))) for a in names}, **{f"p_{a}_{b}": F.sum(dec(F.col(a) * F.col(b))) for a, b in _pairs()}}
    mean = {a: F.col(f"s_{a}").cast("double") / F.col("n") / UNIT for a in names}
    made = [*[mean[a].alias(f"m_{a}") for a in names], *[
        (F.col(f"p_{a}_{b}").cast("double") / F.col("n") / UNIT / UNIT - mean[a] * mean[b]).alias(f"c_{a}_{b}") for a, b in _pairs()]]
    return [x.alias(k) for k, x in parts.items()], [F.sum(k).alias(k) for k in parts], made


def _concentrated(rows: DataFrame, groups: DataFrame, n_groups: int, distance: Column, sums: tuple[list[Column], list[Column], list[Column]]) -> DataFrame:
    """One concentration step: per group and start, the estimate from the
    nearest ``H`` of the rows.  Counts, sums and products are made per bin of
    distance, in one pass; the bins up to the cut are added up after it."""
    parts, totals, made = sums
    near = _per_group(rows, groups, n_groups).withColumn("d", distance).select("g", "s", *VECTOR, _bin().alias("bin"))
    bins = near.groupBy("g", "s", "bin").agg(*parts)
    of = Window.partitionBy("g", "s")
    bins = bins.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
    kept = bins.where(F.col("upto") - F.col("n") < F.col("all") * H).groupBy("g", "s").agg(*totals)
    return kept.select("g", "s", *made)


def _tail(rows: DataFrame, groups: DataFrame, n_groups: int, distance: Column, fence: float) -> DataFrame:
    """Per group the ``scale`` that gives distances the median of chi-square,
    and ``limit``: on cube roots of the scaled distances, which are nearly
    normal for normal vectors, ``fence`` quartile ranges above the upper
    quartile (the outer fence at 3), and never below that of chi-square."""
    bins = _per_group(rows, groups, n_groups).withColumn("d", distance).groupBy("g", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    bins = bins.withColumn("upto", F.sum("k").over(Window.partitionBy("g").orderBy("bin"))).withColumn("all", F.sum("k").over(Window.partitionBy("g")))
    at = lambda q: F.greatest(F.expm1((F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) + 0.5) / 64), F.lit(0.05))
    found = bins.groupBy("g").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3")).withColumn("scale", F.lit(CHI5[1]) / F.col("q2"))
    low, high = F.cbrt(F.col("q1") * F.col("scale")), F.cbrt(F.col("q3") * F.col("scale"))
    least = [x ** (1 / 3) for x in CHI5]
    limit = F.greatest(high + fence * (high - low), F.lit(least[2] + fence * (least[2] - least[0])))
    return found.select("g", "scale", F.pow(limit, F.lit(3.0)).alias("limit"))


def robust_estimates(rows: DataFrame, fence: float = 3.0, settled: float = 1e-3) -> DataFrame:
    """Per group ``g`` its size ``n``, centre ``m_*``, inverse factor ``w_*``,
    ``logdet``, the steps taken, ``scale`` and ``limit`` (see ``_tail``).

    Every start is concentrated until a step lowers the logarithm of its
    determinant by less than ``settled``; a start that has settled takes no
    further steps.  The start with the least determinant is the estimate."""
    inverse, distance, sums = _inverse(), _distance(), _sums()  # made once for all steps
    middle = staged(_middle(rows), "mcd-middle")
    n = middle.count()
    begun = staged(_inverted(_starts(rows, middle, n), inverse), "mcd-starts")
    n_starts = 4 * n  # no step has more rows
    now = staged(_inverted(_concentrated(rows, begun, n_starts, distance, sums), inverse).withColumns({"steps": F.lit(1), "going": F.lit(True)}), "mcd")
    files = now.inputFiles()
    kept = [c for c in now.columns if c not in ("g", "s", "steps", "going")]
    better = F.col("new.logdet") < F.col("logdet")  # else the estimate before stays
    stepped = ["g", "s", *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in kept],
               (F.col("steps") + better.cast("int")).alias("steps"), (F.col("new.logdet") < F.col("logdet") - settled).alias("going")]
    new = ["g", "s", F.struct(*kept).alias("new")]
    while not now.isEmpty():
        after = _inverted(_concentrated(rows, now, n_starts, distance, sums), inverse).select(*new)
        now = staged(now.join(after, ["g", "s"]).select(*stepped), "mcd")
        files += now.inputFiles()
        now = now.where("going")
    # all steps' files in one scan: a union of the steps would be a plan that grows with their number
    every = rows.sparkSession.read.schema(now.schema).parquet(*files).where("NOT going").drop("going")
    place = F.struct("logdet", "s")
    best = every.groupBy("g").agg(F.min_by(F.struct(*[c for c in every.columns if c != "g"]), place).alias("b")).select("g", "b.*")
    best = staged(best, "mcd-best")
    return best.join(_tail(rows, best, n, distance, fence), "g").join(middle.select("g", "n"), "g")


def quality(docs: DataFrame, least_words: int = 10, most_repeat_pct: int = 20, fence: float = 3.0,
            least_group: int = 200) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, lang, source``): the counts,
    ``base_failed``, the robust squared ``distance``, the group's ``cutoff`` for
    it and ``kept``.

    Estimates rest on all rows that pass the base rules.  A (language, source)
    with fewer than ``least_group`` of them is measured by its language as a
    whole, and that, if too small, by all documents.  The cutoff is taken from
    each group's own distances (``_tail``), as texts have heavier tails than
    normal vectors.

    * null and empty texts have zero counts and fail the base rules;
    * null languages and sources are groups of their own;
    * repeated rows count as often as they occur and get equal results;
    * where no row passes the base rules, distances are null and nothing is kept;
    * an empty table gives an empty result; other columns are not read.
    """
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat_pct)
    rows = staged(text_statistics(docs).withColumns({"base_failed": base, **_vector()}), "statistics")
    name = lambda *c: F.to_json(F.array(*[F.col(x).cast("string") for x in c])) if c else F.lit("[]")
    rows = rows.withColumns({"g2": name("lang", "source"), "g1": name("lang"), "g0": name()})
    good = rows.where(~F.col("base_failed"))
    sizes = staged(good.groupBy("g2", "g1", "g0").agg(F.count(F.lit(1)).alias("k2")), "sizes")
    by_lang = sizes.groupBy("g1").agg(F.sum("k2").alias("k1"), F.min("k2").alias("least2"))
    least1 = by_lang.agg(F.min("k1")).first()[0]
    rows = rows.join(small(sizes.select("g2", "k2"), MOST_GROUPS), "g2", "left").join(small(by_lang, MOST_GROUPS), "g1", "left")
    rows = rows.withColumn("g", F.when(F.col("k2") >= least_group, F.col("g2")).when(F.col("k1") >= least_group, F.col("g1")).otherwise(F.col("g0")))
    # a row counts in its own group, and in those wider ones that a small group needs
    wider = F.array(F.when(F.col("k2") >= least_group, F.col("g2")), F.when(F.col("least2") < least_group, F.col("g1")),
                    F.when(F.lit(least1 is not None and least1 < least_group), F.col("g0")))
    tall = rows.where(~F.col("base_failed")).select(F.explode(F.filter(wider, lambda x: x.isNotNull())).alias("g"), *VECTOR)
    # read by every step, so without the joins above
    found = staged(robust_estimates(staged(tall, "vectors"), fence), "estimates")
    judged = rows.join(small(found.drop("n", "s"), MOST_GROUPS), "g", "left").withColumn("distance", _distance() * F.col("scale"))
    return judged.withColumn("cutoff", F.col("limit")).select(
        "doc_id", "version", *OUT[:6], "distance", "cutoff", (~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(False))).alias("kept"))


def kept_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    good = quality(docs, **limits).where("kept").select(F.col("doc_id").alias("_id"), F.col("version").alias("_v")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_v")), "left_semi")
