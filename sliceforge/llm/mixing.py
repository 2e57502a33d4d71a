"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

The mixture is a row of slots.  A slot holds one block of documents of one
source.  With integer weights w that add up to the period Q, block k of a source
may not start before slot floor(k*Q/w) and must be done by slot ceil((k+1)*Q/w);
the earliest deadline among the released blocks takes each slot.  The weights
fill every slot, so all deadlines are met and after any number of slots each
source is less than one block away from its share.  The schedule repeats every Q
slots: only one period is worked out, and each block looks up its slot there.
Q grows with the number of sources and the smallest share, so that every weight
is close to its target; long periods are scheduled by ``long_schedule``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

BLOCK_DOCS = 16
PERIOD = 1000
#: The smallest weight: rounding moves no weight by more than 1 part in 64.
LEAST_WEIGHT = 32
#: Slots, and slots times sources, up to which a period is folded in one row.
FOLD_SLOTS = 4000
FOLD_STEPS = 400_000


def _source_key(col: str) -> F.Column:
    # A null source is a source of its own, apart from the empty name.
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("null"))


def tempered_weights(df: DataFrame, source_col: str = "source", alpha: float = 0.5, period: int = PERIOD) -> DataFrame:
    """(source_key, n, w): documents and integer weight of every source, the
    weights in proportion to n ** alpha and about ``period`` in sum, or more if
    the smallest would be below LEAST_WEIGHT."""
    counts = df.groupBy(_source_key(source_col).alias("source_key")).agg(F.count("*").alias("n"))
    power = F.sqrt(F.col("n").cast("double")) if alpha == 0.5 else F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    total, least = F.sum(power).over(Window.partitionBy()), F.min(power).over(Window.partitionBy())
    slots = F.greatest(F.lit(float(period)), F.ceil(F.lit(float(LEAST_WEIGHT)) * total / least).cast("double"))
    return counts.select("source_key", "n", F.greatest(F.lit(1), F.floor(slots * power / total + 0.5)).cast("long").alias("w"))


def given_weights(df: DataFrame, weights: dict[str | None, int], source_col: str = "source") -> DataFrame:
    """(source_key, n, w) for stated integer weights; sources that the table has
    and ``weights`` lacks are an error, as their documents would be lost."""
    counts = df.groupBy(_source_key(source_col).alias("source_key")).agg(F.count("*").alias("n"))
    pairs = [x for s, w in weights.items() for x in (F.lit("null" if s is None else f"s{s}"), F.lit(int(w)).cast("long"))]
    w = F.element_at(F.create_map(*pairs), F.col("source_key"))
    return counts.select(
        "source_key",
        "n",
        F.when(w > 0, w).otherwise(F.raise_error(F.concat(F.lit("no weight for source "), "source_key")).cast("long")).alias("w"),
    )


def _rows_before(part: list[str], order: list[str], count: F.Column | None = None) -> F.Column:
    w = Window.partitionBy(*part).orderBy(*order)
    if count is None:
        return F.row_number().over(w).cast("long") - 1
    return F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def _first_free(part: list[str], order: list[str]) -> F.Column:
    """Slots of blocks that are taken in order of release: each the first that is
    released and free."""
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(F.col("at") - F.col("nth")).over(before) + nth


def long_schedule(weights: DataFrame, period: int) -> DataFrame:
    """The slots of one period, by earliest deadline, as window functions over
    blocks.  Columns are those of ``period_schedule``.

    By earliest deadline, a block takes the first slot from its release on that
    no block of an earlier deadline takes; which slots a set of blocks takes
    together does not depend on the order in it.  So the blocks are halved by
    the bits of the deadline, from the highest: the slots of the earlier half
    are worked out, and the later half goes on in the numbering of the slots
    that are left (``at`` is the release there).  Blocks of one deadline
    are placed by release, then source, and the numberings are undone from the lowest bit up.
    """
    total = F.lit(period).cast("long")
    blocks = weights.select("source_key", "n", "w", total.alias("period"), F.explode(F.expr("sequence(0L, w - 1)")).alias("place"))
    blocks = blocks.withColumn("release", F.expr("place * period div w")).withColumn("at", F.col("release"))
    blocks = blocks.withColumn("deadline", F.expr("((place + 1) * period + w - 1) div w"))
    bits = int(period).bit_length()
    order = ["at", "source_key", "place"]

    def halves(df: DataFrame, bit: int) -> DataFrame:
        late = F.shiftright("deadline", bit).bitwiseAND(F.lit(1).cast("long"))
        return df.withColumn("half", F.shiftright("deadline", bit + 1)).withColumn("late", late).repartition("half")

    for bit in reversed(range(bits)):
        blocks = halves(blocks, bit).withColumn("nth", _rows_before(["half", "late"], order))
        # Early blocks stand at the slots they take, late ones before those at their release.
        blocks = blocks.withColumn("stand", F.when(F.col("late") == 0, _first_free(["half", "late"], order) - 1).otherwise(F.col("at")))
        taken = _rows_before(["half"], ["stand", F.desc("late"), "source_key", "place"], 1 - F.col("late"))
        blocks = blocks.withColumn("at", F.col("at") - F.when(F.col("late") == 1, taken).otherwise(0))
    # Never against the order of ``at``, which follows the release.
    ties = ["release", "source_key", "place"]
    blocks = blocks.withColumn("nth", _rows_before(["deadline"], ties))
    blocks = blocks.withColumn("at", _first_free(["deadline"], ties) - 1)
    for bit in range(bits):
        # An early block stands at the number of free slots before it; all those
        # up to a late block's number lie before its slot.
        blocks = halves(blocks, bit).withColumn("nth", _rows_before(["half", "late"], order))
        blocks = blocks.withColumn("stand", F.when(F.col("late") == 0, F.col("at") - F.col("nth")).otherwise(F.col("at")))
        taken = _rows_before(["half"], ["stand", "late", "source_key", "place"], 1 - F.col("late"))
        blocks = blocks.withColumn("at", F.col("at") + F.when(F.col("late") == 1, taken).otherwise(0))
    return blocks.select("source_key", "n", "w", "period", F.col("at").alias("slot"), "place")


def period_schedule(weights: DataFrame) -> DataFrame:
    """(source_key, n, w, period, slot, place): the slots of one period, by
    earliest deadline among the released blocks, ties by release, then source.

    A short period is folded over an array of sources in one row; any other
    goes to ``long_schedule``, which gives the same slots.
    """
    size = weights.agg(F.sum("w").alias("q"), F.count("*").alias("n")).first()
    if size["q"] and (size["q"] > FOLD_SLOTS or size["q"] * size["n"] > FOLD_STEPS):
        return materialize(long_schedule(weights, size["q"]), "schedule")
    one = weights.agg(
        F.array_sort(F.collect_list(F.struct("source_key", "n", "w"))).alias("s"), F.sum("w").alias("q")
    ).filter("q is not null")
    # State: blocks done per source, and the picks so far.
    # The pick is used twice per step (count it, list it), hence the inner rebuild.
    fold = """
      aggregate(
        sequence(0, cast(q - 1 as int)),
        named_struct('done', transform(s, x -> 0L), 'picks', cast(array() as array<int>)),
        (acc, t) -> aggregate(
          array(array_min(transform(s, (x, i) -> if(
              acc.done[i] * q div x.w <= t,
              named_struct('deadline', ((acc.done[i] + 1) * q + x.w - 1) div x.w, 'release', acc.done[i] * q div x.w, 'i', i),
              cast(null as struct<deadline: bigint, release: bigint, i: int>)))).i),
          acc,
          (a, pick) -> named_struct(
            'done', transform(a.done, (d, i) -> if(i = pick, d + 1L, d)),
            'picks', concat(a.picks, array(pick)))),
        acc -> acc.picks)
    """
    slots = one.select("s", "q", F.posexplode(F.expr(fold)).alias("slot", "pick")).select(
        F.expr("s[pick].source_key").alias("source_key"),
        F.expr("s[pick].n").alias("n"),
        F.expr("s[pick].w").alias("w"),
        F.col("q").alias("period"),
        F.col("slot").cast("long").alias("slot"),
    )
    place = F.row_number().over(Window.partitionBy("source_key").orderBy("slot")) - 1
    return F.broadcast(slots.withColumn("place", place.cast("long")))


def number_within_source(df: DataFrame, n_by_source: DataFrame, source_col: str, id_col: str) -> DataFrame:
    """``df`` with ``__key`` (source) and ``__r``, the place from 0 in its source,
    by MD5 of the id, then id.

    A source may hold a third of all rows, so it is cut into about sqrt(n)
    ranges of the hash; rows are numbered in their range and shifted by the
    sizes of the ranges before it.
    """
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = df.withColumn("__key", _source_key(source_col)).withColumn("__h", h)
    keyed = keyed.join(
        F.broadcast(n_by_source.select(F.col("source_key").alias("__key"), F.ceil(F.sqrt(F.col("n").cast("double"))).alias("__nb"))),
        "__key",
    )
    part = F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.col("__nb") / F.lit(1 << 32))
    keyed = keyed.withColumn("__part", part.cast("long"))
    sizes = keyed.groupBy("__key", "__part").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(
        Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select("__key", "__part", F.coalesce(before, F.lit(0)).cast("long").alias("__before"))
    in_part = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__h", id_col))
    numbered = keyed.withColumn("__r", in_part.cast("long") - 1).join(sizes, ["__key", "__part"])
    return numbered.withColumn("__r", F.col("__r") + F.col("__before")).drop("__h", "__nb", "__part", "__before")


def mix_sources(
    df: DataFrame,
    weights: DataFrame | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_docs: int = BLOCK_DOCS,
    exhausted: str = "continue",
    out_col: str = "mix",
) -> DataFrame:
    """``df`` with a struct column ``out_col``: source_weight, period, epoch, block,
    release, deadline, slot and place (in the block).  Ordered by (slot, place)
    the rows are the mixture.

    ``exhausted`` says what happens when a source has no block left for a slot:
    ``continue`` leaves the slot empty (every row is placed once), ``repeat``
    starts the source again until every source has been used up once (rows are
    repeated, none is lost; ``epoch`` counts from 0), ``stop`` ends the
    mixture at the first empty slot (rows beyond are not placed: the sampling
    form).

    Defined cases: null sources form a source of their own; ties and repeated
    rows are placed one after the other; null ids come first among equal hashes;
    text plays no part, so null, empty and very long texts are all alike; an
    empty table gives an empty mixture; an input column named ``out_col`` is replaced.
    """
    if exhausted not in ("continue", "repeat", "stop"):
        raise ValueError(f"exhausted: {exhausted!r}")
    weights = tempered_weights(df, source_col) if weights is None else weights
    sched = period_schedule(weights)
    lookup = sched.select(
        F.col("source_key").alias("__key"), F.col("place").alias("__place"), F.col("slot").alias("__slot")
    )
    # The slot that ends the mixture: for every source, the end of the block
    # with its last document.
    blocks = F.expr(f"(n + {block_docs - 1}) div {block_docs}")
    per_source = weights.withColumn("__blocks", blocks)
    total = F.sum("w").over(Window.partitionBy())
    per_source = per_source.withColumn("__q", total)
    end_slot = F.expr("((__blocks) * __q + w - 1) div w")
    limits = per_source.select(
        F.col("source_key").alias("__key"),
        F.col("n").alias("__n"),
        F.col("w").alias("__w"),
        F.col("__q"),
        F.col("__blocks"),
        (F.max(end_slot) if exhausted == "repeat" else F.min(end_slot)).over(Window.partitionBy()).alias("__horizon"),
    )
    rows = number_within_source(df.drop(out_col), weights, source_col, id_col).join(F.broadcast(limits), "__key")
    if exhausted == "repeat":
        # Block k of epoch e is block e * blocks + k of the source's endless row.
        last = F.expr("((__horizon * __w + __q - 1) div __q) div __blocks")
        rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    else:
        rows = rows.withColumn("__epoch", F.lit(0).cast("long"))
    rows = rows.withColumn("__k", F.expr(f"__r div {block_docs} + __epoch * __blocks"))
    rows = rows.withColumn("__place", F.expr("__k % __w")).join(lookup, ["__key", "__place"])
    rows = rows.withColumn("__slot", F.expr("(__k div __w) * __q + __slot"))
    if exhausted != "continue":
        rows = rows.filter("__slot < __horizon")
    keep = [F.col(f"`{c}`") for c in df.columns if c != out_col]
    return rows.select(
        *keep,
        F.struct(
            F.col("__w").alias("source_weight"),
            F.col("__q").alias("period"),
            F.col("__epoch").alias("epoch"),
            F.col("__k").alias("block"),
            F.expr("__k * __q div __w").alias("release"),
            F.expr("((__k + 1) * __q + __w - 1) div __w").alias("deadline"),
            F.col("__slot").alias("slot"),
            F.expr(f"__r % {block_docs}").alias("place"),
        ).alias(out_col),
    )
