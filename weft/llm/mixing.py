"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sizes are words.  Sources in code-point order (null last) weigh 3, 1, 2,
repeating, and share ``share`` times all words; no target exceeds ``repeat``
times its source's size, the excess going to the others by weight.

The words are handed out in blocks of ``block`` words.  Sources get whole
numbers of blocks by the highest quotients target / (2k - 1); each source's
blocks go to its shards the same way.  A shard is a seeded hash cell of about
``MIN_SHARD_WORDS`` words of one source: a larger source has more of them, never
larger ones.  Blocks go down to shards through groups of ``FAN``, level by level,
so a ranking has FAN cells at most.  In a shard the documents form a line of
words in seeded order.  A quota of q blocks of
a line of m blocks is q // m passes over the line plus a run of q % m blocks
from a seeded start, so no word is taken more than ``repeat`` times.

Only the highest-quotient seats near a share can be in doubt, so the ranking
looks at a few candidates for each source (or shard), never at all blocks.

Edge cases: null or blank text has size 0 and takes 0; an empty table, or one
without words, gives zero targets; repeated rows are documents of their own,
numbered so that reruns give each the same; equal seeded hashes are ordered by
id, text hash and size.  A document longer than a shard makes its shard longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._rows import join_on, keyed, matching, real_id
from weft.llm._shared import saved

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 16
SEED = 11
MIN_SHARD_WORDS = 50_000
FAN = 1024


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size); one row for each source, which is all the window sees."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = s.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("rank") % 3 + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(repeat)))
    # Sources reach their limits in the order of limit / weight; the water level is set by those that don't.
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    everyone = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", F.greatest(F.col("left"), F.lit(0.0)) / F.col("w_left"))
        .withColumn("below", F.col("limit") <= F.col("level") * F.col("w"))
    )
    first_open = Window.partitionBy().orderBy(F.col("limit") / F.col("w"), "rank")
    s = s.withColumn(
        "final",
        F.first(F.when(~F.col("below"), F.col("level")), ignorenulls=True).over(
            first_open.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(
        F.least(F.col("limit"), F.col("final") * F.col("w"))
    )
    return s.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def sainte_lague(cells: DataFrame, group: list[str], share: str, seats: str, tie: list[str]) -> DataFrame:
    """Adds ``quota``: seats of each cell so that a group's quotas add up to its ``seats``.

    ``share`` is a cell's exact share of the seats.  Highest quotients decide;
    with n cells in a group the divisor differs from 1 by less than n / (2 seats),
    so seats further than 2 + share * n / seats from the share are certain.
    """
    g = Window.partitionBy(*group)
    c = cells.withColumn("_n", F.count("*").over(g))
    slack = F.ceil(F.col(share) * F.col("_n") / F.greatest(F.col(seats), F.lit(1))) + 2
    c = c.withColumn("_lo", F.greatest(F.floor(F.col(share)) - slack, F.lit(0)).cast("long"))
    c = c.withColumn("_hi", F.when(F.col(share) > 0, F.floor(F.col(share)) + slack).otherwise(F.col("_lo")).cast("long"))
    c = c.withColumn("_open", F.col(seats) - F.sum("_lo").over(g))
    keys = [*group, *tie]
    seat = c.where("_hi > _lo").select(*keys, share, "_open", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("k"))
    quotient = F.col(share) / (2 * F.col("k") - 1)
    seat = seat.withColumn("_r", F.row_number().over(g.orderBy(quotient.desc(), *[F.col(t) for t in tie], "k")))
    won = seat.where("_r <= _open").groupBy(*keys).agg(F.count("*").alias("_won"))
    out = join_on(c, won, keys, "left")
    return out.select(*cells.columns, (F.col("_lo") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _down_to_cells(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``cells`` (source, shard, cell_size) with ``quota``: a source's blocks apportioned through groups of FAN shards, then of FAN groups' shards."""
    depth = 1
    while FAN**depth < most:
        depth += 1
    if depth > 1:
        cells = saved(cells)
    parents = sources.withColumn("node", F.lit(0))
    for level in reversed(range(depth)):
        node = F.floor(F.col("shard") / FAN**level).cast("int")
        here = cells.groupBy("source", node.alias("node")).agg(F.sum("cell_size").alias("cell_size"))
        here = here.withColumn("parent", F.floor(F.col("node") / FAN).cast("int") if level < depth - 1 else F.lit(0))
        here = join_on(here, parents.select("source", F.col("node").alias("parent"), F.col("quota").alias("seats")), ["source", "parent"])
        total = F.sum("cell_size").over(Window.partitionBy("source", "parent"))
        share = F.when(total > 0, F.col("seats") * F.col("cell_size") / total).otherwise(0.0)
        parents = sainte_lague(here.withColumn("share", share), ["source", "parent"], "share", "seats", ["node"])
    return parents.select("source", F.col("node").alias("shard"), "cell_size", "quota")


def mix_plan(docs: DataFrame, share: float = 1.5, repeat: int = 2, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(did, rh, source, size, source_size, target, passes, cut_from, cut_to): what the mix takes of each document.

    A document is taken whole ``passes`` times, and its words [cut_from, cut_to) once more.
    """
    base = keyed(docs, "source")
    sized = base.select("did", "rh", F.col("source").cast("string").alias("source"), n_words("text").alias("size"))
    sized = saved(sized)  # texts are read once
    targets = source_targets(sized, share, repeat)
    targets = targets.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / MIN_SHARD_WORDS), F.lit(1)).cast("int"))
    everyone = Window.partitionBy()
    targets = targets.withColumn("seats", F.round(F.sum("target").over(everyone) / block).cast("long"))
    targets = targets.withColumn("share", F.col("target") / block).withColumn("one", F.lit(1))
    targets = sainte_lague(targets, ["one"], "share", "seats", ["source"]).withColumnRenamed("quota", "blocks")
    targets = saved(targets.select("source", "source_size", "target", "shards", "blocks"))
    d = join_on(sized, targets, ["source"])
    d = d.withColumn("o", F.xxhash64(F.lit(seed), "did", "rh"))
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "did", "rh"), F.col("shards")).cast("int"))
    cells = d.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    most = targets.agg(F.max("shards").alias("m")).first()["m"] or 1
    cells = _down_to_cells(cells, targets.select("source", F.col("blocks").alias("quota")), most)
    m = F.ceil(F.col("cell_size") / block).cast("long")
    cells = cells.withColumn("m", m).withColumn("quota", F.least(F.col("quota"), repeat * F.col("m")))
    cells = cells.withColumn("passes", F.when(F.col("m") > 0, F.floor(F.col("quota") / F.col("m"))).otherwise(0).cast("int"))
    cells = cells.withColumn("run", F.col("quota") - F.col("passes") * F.col("m"))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("m") - F.col("run") + 1)
    cells = cells.withColumn("run_from", start * block).withColumn("run_to", (start + F.col("run")) * block)
    cells = cells.select("source", "shard", "passes", "run_from", "run_to")
    line = Window.partitionBy("source", "shard").orderBy("o", "did", "rh", "size")
    d = d.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    d = join_on(d, cells, ["source", "shard"])
    begin = F.col("end") - F.col("size")
    lo = F.greatest(F.col("run_from") - begin, F.lit(0))
    hi = F.least(F.col("run_to") - begin, F.col("size"))
    return d.select(
        "did", "rh", "source", "size", "source_size", "target", "passes",
        F.when(hi > lo, lo).otherwise(0).cast("long").alias("cut_from"),
        F.when(hi > lo, hi).otherwise(0).cast("long").alias("cut_to"),
    )


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    p = mix_plan(docs, **options)
    taken = F.col("passes") * F.col("size") + F.col("cut_to") - F.col("cut_from")
    return p.select(real_id("did").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows with all columns of ``docs``: a document for each pass that takes it whole, and once more
    with the words of its run, joined by blanks, if the run cuts it; ``n_chars`` is that of the text.

    Documents without words aren't taken.  Rows that repeat id, text and source are numbered in the order of all
    their columns, and plans in the order of what they take, so that reruns agree.
    """
    row, take = ["did", "rh", "source"], ["size", "passes", "cut_from", "cut_to"]
    plan = mix_plan(docs, **options).select(*row, *take).groupBy(*row, *take).agg(F.count("*").alias("n"))
    in_turn = Window.partitionBy(*row).orderBy(*take)
    plan = plan.withColumn("to", F.sum("n").over(in_turn)).withColumn("kinds", F.count("*").over(Window.partitionBy(*row)))
    plan = saved(plan.where("size > 0 AND (kinds > 1 OR passes > 0 OR cut_to > cut_from)"))
    alike = plan.where("kinds = 1")
    rows = matching(docs, alike, *take, source="source")
    apart = plan.where("kinds > 1")
    if not apart.isEmpty():  # repeated rows of which a run takes some
        theirs = matching(docs, apart.select(*row).distinct(), source="source")
        name = ["_row_did", "_row_rh", "source"]
        turn = F.row_number().over(Window.partitionBy(*name).orderBy(F.xxhash64(*docs.columns), *docs.columns))
        theirs = matching(theirs.withColumn("_nth", turn), apart, *take, "n", "to", source="source")
        theirs = theirs.where("_nth > _to - _n AND _nth <= _to").select(*rows.columns)
        rows = rows.unionByName(theirs)
    cut = F.col("_cut_to") - F.col("_cut_from")
    whole = (cut == F.col("_size")) & (F.col("_size") > 0)
    times = (F.col("_passes") + F.when(whole, 1).otherwise(0)).cast("int")
    copies = times + F.when(~whole & (cut > 0), 1).otherwise(0)
    rows = rows.withColumn("_times", times).where(copies > 0).withColumn("_turn", F.explode(F.sequence(F.lit(1), copies)))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("_cut_from") + 1).cast("int"), cut.cast("int"))
    rows = rows.withColumn("text", F.when(F.col("_turn") <= F.col("_times"), F.col("text")).otherwise(F.array_join(words, " ")))
    new = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return rows.withColumns(new).select(*docs.columns)
