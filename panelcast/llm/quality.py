"""Quality rules and robust multivariate outliers, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated runs of eight words.
For every language and source the rows that pass them give a minimum-covariance-
determinant estimate of transformed statistics. It is looked for from three fixed starts:
medians and quartile ranges; the covariance of spatial signs around the medians; mean and
covariance of the half of rows nearest to the medians. From each, the ``COVERAGE`` of rows
with the smallest distances give the next mean and covariance, until no determinant changes
any more by ``SETTLED`` (each step can only shrink it) or ``STEPS`` steps are done. Of a
group's estimates the one with the smallest determinant is taken. A row whose squared
Mahalanobis distance exceeds ``CUTOFF`` is rejected.

Statistics: log of the mean word length; square roots of symbols, repeated lines
and repeated words per word. A standard deviation is at least ``FLOOR``, so statistics
that are zero in most rows stay usable; a larger one is taken as it is.

Groups of fewer than ``LEAST`` rows that pass take the estimate of their language,
or if that has fewer too, of all rows: the same steps run at three levels.

Texts are read once and never shuffled; what follows are a few numbers per row.
Quantiles come from counts of equally wide bins, which combine before the shuffle
and have a fixed size. Estimates are joined back by group and a salt, so that a
group with a third of all rows is dealt over ``SALT`` tasks, and a level's larger
groups over ``WIDE_SALT``.

Defined cases: texts of any length are counted whole; null and empty texts have no words and fail the base rules; null
and empty lang (source) are one group; a table with fewer than ``LEAST``
rows that pass has no estimate and keeps them; a null doc_id stays; repeated rows count and are
judged one by one; ties in distance are all in or all out of a step's subset; an
empty table gives an empty result; other columns are ignored whatever their
names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import materialize

GAP = r"[ \t\n\x0B\f\r]+"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent
COVERAGE = 0.75
#: E(d2) of the inner three quarters of a normal with four dimensions is short
#: of the whole by this factor.
CONSISTENCY = 1.4866
STEPS = 10
SETTLED = 1e-3  # of the logarithm of a determinant
HALF = 0.5
CUTOFF = 23.5  # one in ten thousand of a normal with four dimensions
LEAST = 30
SALT = 32
WIDE_SALT = 256
FLOOR = [0.02, 0.05, 0.05, 0.05]
#: Width of a bin of the statistics; distances have BINS bins for each doubling.
WIDTH = 1 / 256
BINS = 16

DIMENSIONS = 4
X = [f"x{i}" for i in range(DIMENSIONS)]
GROUP = ["level", "lang", "source"]
RUN = [*GROUP, "start"]
ESTIMATE = [f"m{i}" for i in range(DIMENSIONS)] + [f"c{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        text.alias("text"),
    )
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).alias("n_symbols"),
        words.alias("words"),
        lines.alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("words").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        # not a mere field: that would be taken apart anew for every window
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.sequence(F.lit(1), F.size("hashes") - WINDOW_WORDS + 1)
    windows = F.when(
        F.size("hashes") > WINDOW_WORDS,
        F.transform(starts, lambda j: F.xxhash64(F.slice("hashes", j, WINDOW_WORDS))),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows).drop("hashes")
    # texts without a repeated window, most of them, are done here
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, j: F.struct(h.alias("hash"), j.alias("at")))),
    )
    rows = rows.withColumn("ordered", ordered).drop("windows")
    same = lambda x, j: (F.get("ordered", j)["hash"] == x["hash"]) & (j >= 0)
    repeated = F.filter(
        F.transform(
            "ordered",
            lambda x, j: F.when(
                F.coalesce(same(x, j + 1), F.lit(False)) | F.coalesce(same(x, j - 1), F.lit(False)), x["at"]
            ),
        ),
        lambda at: at.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(repeated),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda done, at: F.struct(
            (at + WINDOW_WORDS).alias("end"),
            (done["n"] + at + WINDOW_WORDS - F.greatest(at, done["end"])).alias("n"),
        ),
    )["n"]
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.col("n_words").cast("long").alias("n_words"),
        "word_chars",
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )


def transformed() -> list[Column]:
    """The vector of a row that passes the base rules."""
    n = F.col("n_words")
    return [
        F.log(F.col("word_chars") / n).alias("x0"),
        F.sqrt(F.col("n_symbols") / n).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / n).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x3"),
    ]


def levels(rows: DataFrame) -> DataFrame:
    """Every row three times: in its group, in its language and among all rows."""
    rows = rows.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select(
        "level",
        F.when(F.col("level") < 2, F.col("lang")).otherwise("").alias("lang"),
        F.when(F.col("level") < 1, F.col("source")).otherwise("").alias("source"),
        F.when(F.col("level") < 1, F.col("salt") % SALT).otherwise(F.col("salt")).alias("salt"),
        *X,
    )


def salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.when(F.col("level") < 1, SALT - 1).otherwise(WIDE_SALT - 1))).alias("salt")


def medians(rows: DataFrame) -> DataFrame:
    """Per group: a row count, medians as means m0.., and a diagonal start covariance."""
    long = rows.select(
        *GROUP,
        F.posexplode(F.array(*[F.floor(F.col(x) / WIDTH).cast("long") for x in X])).alias("dim", "bin"),
    )
    bins = long.groupBy(*GROUP, "dim", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*GROUP, "dim")
    bins = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    dims = bins.groupBy(*GROUP, "dim").agg(
        F.max("all").alias("n"),
        ((at(0.5) + 0.5) * WIDTH).alias("middle"),
        ((at(0.75) - at(0.25)) * WIDTH / 1.349).alias("spread"),
    )
    pick = lambda value, i: F.max(F.when(F.col("dim") == i, value))
    return dims.groupBy(*GROUP).agg(
        F.max("n").alias("n"),
        *[pick(F.col("middle"), i).alias(f"m{i}") for i in range(DIMENSIONS)],
        *[
            (pick(F.col("spread") * F.col("spread"), i) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i, j in PAIRS
        ],
    )


def moments(rows: DataFrame) -> DataFrame:
    """Per group and start: mean and covariance of the rows."""
    sums = rows.groupBy(*RUN).agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)],
        *[F.covar_pop(X[i], X[j]).alias(f"v{i}{j}") for i, j in PAIRS],
    )
    return sums.select(
        *RUN, *[f"m{i}" for i in range(DIMENSIONS)],
        *[(F.col(f"v{i}{j}") * CONSISTENCY).alias(f"c{i}{j}") for i, j in PAIRS],
    )


def factor(estimates: DataFrame, more: list[str] = ()) -> DataFrame:
    """The means, the Cholesky factor l00.. of each covariance, with no deviation under
    ``FLOOR``, and further columns."""
    for i, j in PAIRS:
        done = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        rest = F.col(f"c{i}{j}") - reduce(add, done) if done else F.col(f"c{i}{j}")
        value = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
        estimates = estimates.withColumn(f"l{i}{j}", value)
    keys = [c for c in RUN if c in estimates.columns]
    kept = dict.fromkeys([*[f"m{i}" for i in range(DIMENSIONS)], *more])
    return estimates.select(*keys, *kept, *[f"l{i}{j}" for i, j in PAIRS])


def log_determinants(estimates: DataFrame) -> DataFrame:
    """Adds ``size``, the logarithm of each covariance's determinant."""
    size = reduce(add, [2 * F.log(f"l{i}{i}") for i in range(DIMENSIONS)])
    return factor(estimates, ESTIMATE).select(*RUN, *ESTIMATE, size.alias("size"))


def standardised(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Adds z0.., a row for each start; null for groups without an estimate if they stay."""
    spread = factor(estimates).select("*", salts())
    out = rows.join(spread, [*GROUP, "salt"], how)
    for i in range(DIMENSIONS):
        done = [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)]
        shift = F.col(f"x{i}") - F.col(f"m{i}")
        out = out.withColumn(f"z{i}", (shift - reduce(add, done) if done else shift) / F.col(f"l{i}{i}"))
    return out


def squared() -> Column:
    return reduce(add, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMENSIONS)])


def distances(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Adds ``d2``, and ``start`` if the estimates have one."""
    extra = ["start"] if "start" in estimates.columns else []
    return standardised(rows, estimates, how).select(*rows.columns, *extra, squared().alias("d2"))


def signs(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """Per group the medians, and the covariance of the rows' directions from them."""
    turned = standardised(rows, middle).withColumn("d2", squared()).where("d2 > 0")
    keys = [*GROUP, *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{i}{i}" for i in range(DIMENSIONS)]]
    sums = turned.groupBy(*keys).agg(
        *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("d2")).alias(f"v{i}{j}") for i, j in PAIRS]
    )
    return sums.select(
        *GROUP, *[f"m{i}" for i in range(DIMENSIONS)],
        *[(DIMENSIONS * F.col(f"v{i}{j}") * F.col(f"l{i}{i}") * F.col(f"l{j}{j}")).alias(f"c{i}{j}") for i, j in PAIRS],
    )


def starts(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """The estimates that steps begin with, numbered by ``start``."""
    columns = [*GROUP, *ESTIMATE]
    first = middle.select(*columns, F.lit(0).alias("start"))
    turned = signs(rows, middle).select(*columns, F.lit(1).alias("start"))
    near = distances(rows, middle).withColumn("start", F.lit(2))
    half = moments(inner(near, HALF)).select(*columns, "start")
    return first.unionByName(turned).unionByName(half)


def inner(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows with the smallest ``d2``, a share of ``coverage`` for each group and start."""
    rows = rows.where("d2 IS NOT NULL").withColumn(
        "bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS).cast("long")
    )
    bins = rows.groupBy(*RUN, "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*RUN)
    cut = (
        bins.withColumn("upto", F.sum("n").over(group.orderBy("bin")))
        .withColumn("all", F.sum("n").over(group))
        .where(F.col("upto") >= coverage * F.col("all"))
        .groupBy(*RUN)
        .agg(F.min("bin").alias("cut"))
        .select("*", salts())
    )
    return rows.join(cut, [*RUN, "salt"]).where(F.col("bin") <= F.col("cut")).drop("bin", "cut", "d2")


def smallest(rows: DataFrame, middle: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per group the estimate of the smallest determinant that the starts lead to."""
    # one small table per step, so the driver keeps few plans and jobs
    estimates = materialize(log_determinants(starts(rows, middle)))
    for _ in range(steps):
        before = estimates.select(*RUN, F.col("size").alias("before"))
        now = log_determinants(moments(inner(distances(rows, estimates))))
        estimates = materialize(now.join(before, RUN, "left"))
        moved = estimates.agg(F.max(F.abs(F.col("size") - F.col("before")))).first()[0]
        if moved is None or moved < SETTLED:
            break
    best = estimates.groupBy(*GROUP).agg(F.min_by(F.struct(*ESTIMATE), F.struct(F.round("size", 9), "start")).alias("best"))
    return best.select(*GROUP, "best.*")


def chosen(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each group's estimate: its own, else its language's, else that of all rows."""
    out = groups
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        own = estimates.where(F.col("level") == level).select(*keys, F.struct(*ESTIMATE).alias(f"by{level}"))
        out = out.join(own, keys, "left") if keys else out.join(own, how="left")
    out = out.withColumn("by", F.coalesce("by0", "by1", "by2")).where(F.col("by").isNotNull())
    return out.select(F.lit(0).alias("level"), "lang", "source", "by.*")


def judge(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and d2 (null without a verdict)."""
    stats = base_statistics(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(WIDE_SALT)).cast("int"))
    stats = materialize(stats)
    rows = levels(stats.where(~F.col("base_failed")).select("lang", "source", "salt", *transformed()))
    middle = materialize(medians(rows))
    groups = middle.where("level = 0").select("lang", "source")
    estimates = materialize(smallest(rows, middle.where(F.col("n") >= LEAST), steps))
    passed = stats.where(~F.col("base_failed")).select("*", *transformed())
    passed = passed.withColumn("level", F.lit(0)).withColumn("salt", F.col("salt") % SALT)
    judged = distances(passed, chosen(groups, estimates), "left").drop(*X, "level")
    failed = stats.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    verdict = F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return (
        judged.unionByName(failed)
        .withColumn("kept", ~F.col("base_failed") & verdict)
        .drop("lang", "source", "salt")
    )
