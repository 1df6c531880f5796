"""Mixing sources to target weights by entropy balancing. DataFrame and SQL functions only.

Every document gets a rate, its expected number of copies. The rates are the
ones nearest to one copy each (least relative entropy, at most ``MAX_COPIES``
copies) whose tokens per source meet the source's target. Their dual is
convex with one multiplier per source: a document of x mean sizes has rate
min(MAX_COPIES, exp(lambda * x)). Newton steps with a bracket as safeguard
find all multipliers at once; a step is one join and one grouped sum.

Rates depend on a document only through source and size, so documents are
first counted in cells of (source, size to 1/64 of an octave). Newton steps
and rounding work on cells: at most 64 per octave and source, however many
documents there are. Rounding goes through a source's cells from large to
small documents and gives each a whole number of copies, carrying the tokens
it is over or under; the error that is left is below half of its smallest
documents. Inside a cell the extra copies go to the documents with the
smallest hashes, exactly as many as planned at every size: hashes are counted
in buckets of about ``BUCKET_DOCS`` documents, the bucket that holds the last
extra copy is opened, and its distinct hashes are counted. Equal rows share a
hash; those at the cut are told apart by their place in the input, by the same
counts. So no cell is ever sorted or gathered in one task.

Targets: sources in code-point order, null last, weigh ``WEIGHTS`` in turn
and share ``SHARE`` of all tokens; a target stops at MAX_COPIES times its
source and the excess is shared again by weight.

Defined cases: null or empty text has size 0 and takes nothing; a null source
is a source of its own; equal rows (same id, text and source) may get
different numbers of copies, which of them is settled by their place in the
input; an empty table gives an empty mix; reruns over the same files agree;
texts of any length are counted whole; extra columns of any name are kept by
``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BUCKET_DOCS = 1000
CELLS_PER_OCTAVE = 64
TOLERANCE = 1e-9
STEPS_PER_ROUND = 6
MAX_ROUNDS = 12


def size_of(text_col: str) -> Column:
    """Words of the text (runs of characters other than ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source_col: str) -> Column:
    """Never null: null and the text 'null' stay apart."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("n"))


def cell_of(size: str) -> Column:
    """Lower end of the size cell: exact up to CELLS_PER_OCTAVE, then CELLS_PER_OCTAVE cells per octave."""
    s = F.col(size)
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(s, F.lit(1)))) - 6).cast("long"))
    return (F.floor(s / step) * step).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(src, source_size, target) from (src, source_size): water filling by weight with a cap per source.

    One row per source: the windows without partition run over the list of sources only.
    """
    order = Window.orderBy(F.col("src") == "n", "src")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = sizes.withColumn("w", F.element_at(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1))
    # sources reach their cap in the order of cap / weight; before the k-th, the uncapped share the rest by weight
    full = (F.lit(float(cap)) * F.col("source_size")).alias("full")
    level = weighed.withColumn("full", full).withColumn("level", F.col("full") / F.col("w"))
    w = Window.orderBy("level", "src")
    everything = Window.partitionBy()
    state = (
        level.withColumn("capped", F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_w", F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("theta", (F.lit(float(share)) * F.col("all") - F.coalesce("capped", F.lit(0.0))) / F.col("open_w"))
        # the level at which the shares stand: the first theta that its own and all later caps exceed
        .withColumn("at", F.min(F.when(F.col("theta") <= F.col("level"), F.struct("level", "theta"))).over(everything)["theta"])
    )
    return state.select("src", "source_size", F.least("full", F.coalesce(F.col("at") * F.col("w"), F.col("full"))).alias("target"))


def _newton(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """(src, lam) with sum(tokens * min(cap, exp(lam * x))) = target for every source below its cap."""
    cap = float(MAX_COPIES)
    bounds = cells.filter("mean > 0").groupBy("src").agg(F.min("x").alias("x0"))
    state = (
        goal.filter((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - TOLERANCE)) & (F.col("target") > 0))
        .join(bounds, "src")
        .select(
            "src", "target", F.lit(0.0).alias("lam"),
            F.least(F.lit(-1e-9), F.log(F.col("target") / F.col("source_size")) / F.col("x0")).alias("lo"),
            (F.lit(0.6931471805599453) / F.col("x0")).alias("hi"), F.lit(1.0).alias("off"),
        )
    )
    x, t = F.col("x"), F.col("tokens")
    r = F.exp(F.least(F.col("lam") * x, F.lit(0.6931471805599453)))
    for _ in range(MAX_ROUNDS):
        for _ in range(STEPS_PER_ROUND):
            g = F.sum(t * r) - F.first("target")
            h = F.sum(F.when(F.col("lam") * x < F.lit(0.6931471805599453), t * x * r).otherwise(0.0))
            step = (
                cells.join(state, "src").groupBy("src")
                .agg(F.first("target").alias("target"), F.first("lam").alias("lam"), F.first("lo").alias("lo"),
                     F.first("hi").alias("hi"), g.alias("g"), h.alias("h"))
                .withColumn("lo", F.when(F.col("g") <= 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
                .withColumn("hi", F.when(F.col("g") >= 0, F.least("hi", "lam")).otherwise(F.col("hi")))
                .withColumn("next", F.when(F.col("h") > 0, F.col("lam") - F.col("g") / F.col("h")))
            )
            inside = (F.col("next") >= F.col("lo")) & (F.col("next") <= F.col("hi"))
            lam = F.when(F.abs("g") <= TOLERANCE * F.col("target"), F.col("lam")).otherwise(
                F.when(inside, F.col("next")).otherwise((F.col("lo") + F.col("hi")) / 2))
            state = step.select("src", "target", lam.alias("lam"), "lo", "hi", (F.abs("g") / F.col("target")).alias("off"))
        state = written(state, "mixing-newton")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= 1e-6:
            break
    return state.select("src", "lam")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, src, size, cell, h): what mixing needs of a document; texts are read once."""
    return docs.select(
        F.col(id_col).alias("id"), source_key(source_col).alias("src"), size_of(text_col).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col)).alias("h"), place().alias("t"),
    ).withColumn("cell", cell_of("size"))


def place() -> Column:
    """A hash of the row's place in the input: the same whenever the same files are read."""
    return F.xxhash64(F.monotonically_increasing_id())


def hash_cuts(rows: DataFrame, wanted: DataFrame, keys: list[str], h: str) -> DataFrame:
    """(keys, cut, short, tied): ``short`` of the ``tied`` rows at hash ``cut`` and all rows below it are the ``extra`` smallest.

    ``wanted`` has (keys, n, extra), the rows of a group and how many of them are wanted.
    """
    group = Window.partitionBy(*keys)
    spread = F.greatest(F.lit(1), (F.col("n") / F.lit(BUCKET_DOCS)).cast("long"))
    of = F.least(spread - 1, F.floor((F.col(h) / F.lit(2.0**64) + F.lit(0.5)) * spread)).cast("long")
    marked = rows.join(wanted.filter("extra > 0"), keys).withColumn("b", of)
    upto = lambda order: F.sum("m").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    holds = F.col("want").between(F.col("upto") - F.col("m") + 1, F.col("upto"))
    counts = marked.groupBy(*keys, "b").agg(F.count("*").alias("m"), F.first("extra").alias("want"))
    bucket = counts.withColumn("upto", upto("b")).filter(holds).select(*keys, "b", (F.col("want") - F.col("upto") + F.col("m")).alias("want"))
    inside = marked.join(bucket, [*keys, "b"]).groupBy(*keys, F.col(h).alias("cut")).agg(F.count("*").alias("m"), F.first("want").alias("want"))
    found = inside.withColumn("upto", upto("cut")).filter(holds)
    return found.select(*keys, "cut", (F.col("want") - F.col("upto") + F.col("m")).alias("short"), F.col("m").alias("tied"))


def plan(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Copies per cell from ``measured`` rows: (src, cell, source_size, target, base, cut, tie).

    A document takes ``base`` copies and one more when its hash is below ``cut``, or equal and its place hash not above ``tie``.
    """
    cells = written(rows.groupBy("src", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "mixing-cells")
    goal = written(targets(cells.groupBy("src").agg(F.sum("tokens").alias("source_size"), F.sum("n").alias("docs"))
                           .select("src", "source_size"), share), "mixing-targets")
    per = cells.join(goal, "src").withColumn("mean", F.col("tokens") / F.col("n"))
    total = Window.partitionBy("src")
    per = per.withColumn("x", F.col("mean") / F.greatest(F.col("source_size") / F.sum("n").over(total), F.lit(1e-12)))
    lam = _newton(per.select("src", "tokens", "mean", "x"), goal)
    rate = F.when(F.col("lam").isNotNull(), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(0.6931471805599453)))).otherwise(
        F.when(F.col("target") > 0, F.lit(float(MAX_COPIES))).otherwise(F.lit(0.0)))
    rated = per.join(lam, "src", "left").withColumn("want", F.when(F.col("mean") > 0, F.col("n") * rate).otherwise(F.lit(0.0)))
    # whole copies per cell, large documents first, the tokens left over carried on; one array per source, bounded by the cells
    folded = (
        rated.groupBy("src", "source_size", "target")
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("mean", "cell", "n", "want")))).alias("cs"))
        .select("src", "source_size", "target", F.explode(F.expr(f"""
            aggregate(cs, named_struct('over', 0D, 'out', cast(array() as array<struct<cell:bigint,n:bigint,m:bigint>>)),
              (acc, c) -> named_struct(
                'over', acc.over + c.mean * c.want - c.mean * {_COPIES},
                'out', concat(acc.out, array(named_struct('cell', c.cell, 'n', c.n, 'm', {_COPIES})))),
              acc -> acc.out)""")).alias("c"))
    )
    copies = written(
        folded.select("src", "source_size", "target", "c.cell", "c.n", F.expr("c.m div c.n").alias("base"), F.expr("c.m % c.n").alias("extra")),
        "mixing-copies",
    )
    cell = ["src", "cell"]
    cuts = written(hash_cuts(rows.select(*cell, "h"), copies.select(*cell, "n", "extra"), cell, "h"), "mixing-cuts")
    # equal rows at the cut of which only some are wanted
    split = cuts.filter(F.col("short") < F.col("tied")).select(*cell, F.col("cut").alias("h"), F.col("tied").alias("n"), F.col("short").alias("extra"))
    ties = hash_cuts(rows.select(*cell, "h", "t"), split, [*cell, "h"], "t").select(*cell, F.col("cut").alias("tie"))
    return copies.join(cuts.select(*cell, "cut"), cell, "left").join(ties, cell, "left").select(*cell, "source_size", "target", "base", "cut", "tie")


#: Copies of a cell: nearest whole number to what it wants plus what was left over, between 0 and the cap.
_COPIES = (
    f"cast(case when c.mean > 0 then greatest(0D, least({float(MAX_COPIES)}D * c.n, round(c.want + acc.over / c.mean))) else 0D end as bigint)"
)


def copies_of(base: str = "base", cut: str = "cut", tie: str = "tie", h: str = "h", t: str = "t") -> Column:
    last = (F.col(h) == F.col(cut)) & F.coalesce(F.col(t) <= F.col(tie), F.lit(True))
    return (F.col(base) + F.coalesce(((F.col(h) < F.col(cut)) | last).cast("long"), F.lit(0))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE) -> DataFrame:
    """One narrow row per document: doc_id, size, source_size, target, copies, taken."""
    rows = written(measured(docs, id_col, text_col, source_col), "mixing-sizes")
    placed = rows.join(written(plan(rows, share), "mixing-plan"), ["src", "cell"])
    n = copies_of()
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        F.when(F.col("size") > 0, n).otherwise(F.lit(0)).cast("long").alias("copies"), (n * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns. Texts meet only the bounded cell plan."""
    rows = written(measured(docs, id_col, text_col, source_col), "mixing-sizes")
    cells = written(plan(rows, share), "mixing-plan").select("src", "cell", "base", "cut", "tie")
    # the document rides in one column, so that its columns can have any names; its words are counted once per row
    keyed = docs.select(
        F.struct("*").alias("doc"), source_key(source_col).alias("src"), size_of(text_col).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col)).alias("h"), place().alias("t"),
    ).withColumn("cell", cell_of("size"))
    n = F.when(F.col("size") > 0, copies_of()).otherwise(F.lit(0)).cast("int")
    return keyed.join(cells, ["src", "cell"]).select("doc", F.explode(F.array_repeat(F.lit(1), n))).select("doc.*")
