"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

A document of a source with target T and size S is wanted T / S times: a whole number of copies and
a fraction. Fractions are rounded in pairs: words move from one document of a pair to the other, in
one of the two directions at random so that each fraction stays right on average, until one of them
is integral; the other goes on. Words moved are words kept, so a source's taken words differ from its
target by less than the size of the one document that is left over at the end. Blocks of about BLOCK
documents of a source are rounded first, from the largest to the least so that the residual tends to
be small; the residuals meet in blocks again, level by level, until one is left for each source, and
that one is drawn by its fraction.
All draws are hashes of what a document holds, so reruns agree, however the table is split. Rows whose
id is null or repeated are told apart by source, size and text, and those alike in all of that by their
number among their like, so that they are interchangeable; so no block is much larger than BLOCK,
however large a source is or however often an id comes.

Rows: null and empty texts have size 0 and none is taken; null is a source of its own, the last;
repeated rows are rounded each by itself, and `mixed` repeats each row as often as that row was taken;
a source of size 0 has target 0; an empty table gives an empty table; other columns are kept by `mixed`
whatever their names. Sources are ranked without any single task seeing all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.llm.columns import fresh
from strandfold.operators.groups import numbered
from strandfold.operators.places import placed

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
MAX_LEVELS = 40
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, size): shares by weight, none above MOST times the source's size."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = durable(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    share, capped = 0.0, -1
    while True:  # the set of capped sources only grows
        above = F.col("weight") * share > MOST * F.col("source_size")
        got = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, MOST * F.col("source_size")).otherwise(0)).alias("given"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("capped"),
        ).first()
        if got["capped"] == capped or not got["weight"]:
            break
        share, capped = (got["total"] - got["given"]) / got["weight"], got["capped"]
    return ranked.select("source", "source_size", F.least(F.col("weight") * share, (MOST * F.col("source_size")).cast("double")).alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _pair(level: int):
    """The step of a block's chain: the carried document meets the next."""

    def step(state: Column, item: Column) -> Column:
        carry = state["carry"]
        a, b = carry["p"] * carry["size"], item["p"] * item["size"]
        up = F.least(carry["size"] - a, b)  # words from the item to the carried one
        down = F.least(a, item["size"] - b)
        rise = _draw(carry["doc_id"], item["doc_id"], carry["size"], item["size"], F.lit(level)) * (up + down) < down
        full, empty = carry["size"] - a <= b, a <= item["size"] - b  # who becomes integral, going up and going down

        def with_(row: Column, p: Column) -> Column:
            return row.withField("p", p)

        lone = carry.isNull() | (carry["p"] <= 0) | (carry["p"] >= 1)
        done = (
            F.when(lone, carry)
            .when(rise & full, with_(carry, F.lit(1.0)))
            .when(rise, with_(item, F.lit(0.0)))
            .when(empty, with_(carry, F.lit(0.0)))
            .otherwise(with_(item, F.lit(1.0)))
        )
        left = (
            F.when(lone, item)
            .when(rise & full, with_(item, (b - up) / item["size"]))
            .when(rise, with_(carry, (a + up) / carry["size"]))
            .when(empty, with_(item, (b + down) / item["size"]))
            .otherwise(with_(carry, (a - down) / carry["size"]))
        )
        return F.struct(F.concat(state["done"], F.array(done)).alias("done"), left.alias("carry"))

    return step


FIELDS = ["doc_id", "salt", "size", "copies", "p", "source_size", "target", "row"]


def _round(rows: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Each block's rows after its chain, from the largest size to the least; all but one have p 0 or 1."""
    item = F.struct((-F.col("size")).alias("order"), *[F.col(c) for c in FIELDS])
    block = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = block.schema["items"].dataType.elementType.simpleString()
    start = F.expr(f"named_struct('done', cast(array() as array<{kind}>), 'carry', cast(null as {kind}))")
    chain = F.aggregate("items", start, _pair(level), lambda s: F.array_compact(F.concat(s["done"], F.array(s["carry"]))))
    return block.select("source", F.explode(chain).alias("r")).select("source", *[f"r.{c}" for c in FIELDS])


def _salted(docs: DataFrame, doc_id: str, text: str, source: str, row: Column) -> DataFrame:
    """(doc_id, source, size, row, salt): salt tells rows apart whose id is null or comes again, else it is 0."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text)).alias("told"), row.alias("row"))
    rows = durable(rows, "sizes")
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    marked = durable(rows.join(durable(again, "again"), "doc_id", "left"), "sizes")
    shared = F.coalesce("again", F.lit(False)) | F.col("doc_id").isNull()
    alike = marked.where(shared).withColumn("like", F.xxhash64("doc_id", "source", "size", "told"))
    apart = placed(alike, "like", [F.col("row")], "among").withColumn("salt", F.xxhash64("like", "place"))
    kept = ["doc_id", "source", "size", "row", "salt"]
    return durable(marked.where(~shared).withColumn("salt", F.lit(0).cast("long")).select(*kept).unionByName(apart.select(*kept)), "salted")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, row) per row of docs.

    row: a number that tells rows apart and decides nothing else; where none is given, rows are numbered as they are read.
    """
    sizes = _salted(docs, doc_id, text, source, F.monotonically_increasing_id() if row is None else row)
    goal = targets(sizes)
    rows = sizes.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(wanted).cast("long")
    p = F.when(F.col("size") > 0, wanted - copies).otherwise(0.0)
    rows = rows.select("doc_id", "source", "row", "salt", "size", copies.alias("copies"), p.alias("p"), "source_size", "target")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    settled = rows.where(~open_)
    live, pieces = rows.where(open_), [settled.select("source", *FIELDS)]
    for level in range(MAX_LEVELS):
        many = live.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        many = many.select(F.col("source").alias("s"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        dealt = live.join(many, F.col("source").eqNullSafe(F.col("s")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "salt", F.lit(level)), "blocks"))
        done = durable(_round(dealt, ["source", "block"], level), "rounded")
        pieces.append(done.where(~open_))
        live = done.where(open_)
        most = live.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= 1:
            break
    pieces.append(live.withColumn("p", (_draw(F.col("doc_id"), F.col("size"), F.lit(-1)) < F.col("p")).cast("double")))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    copies = (F.col("copies") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it."""
    row, copies, again = fresh(docs, "row", "copies", "again")
    placed = durable(docs.withColumn(row, F.monotonically_increasing_id()), "placed")  # so a row keeps its number
    taken = mix(placed, doc_id, text, source, F.col(row)).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    return placed.join(taken, row).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
