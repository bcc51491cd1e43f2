"""Ordered-sequence operators over rows: upserts, runs, extents, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import leading
from quire.lineage import settle


MARK = "struct<idx:int,level:int,section_type:string,name:string,conf:double,evidence:array<string>,flags:map<string,string>>"


def merged(marks: Column) -> Column:
    """One mark of an array of marks (MARK or null) of a block and level, in order: a surer one gives type and name, and its evidence stands
    first."""
    def surer(a: Column, b: Column) -> Column:
        flags = F.map_concat(F.map_filter(a["flags"], lambda k, _: ~F.map_contains_key(b["flags"], k)), b["flags"])
        both = F.struct(a["idx"], a["level"], b["section_type"], b["name"], b["conf"], F.concat(b["evidence"], a["evidence"]), flags).cast(MARK)
        return F.when(a.isNull(), b).when(b["conf"] > a["conf"], both).otherwise(a)

    return F.reduce(F.array_compact(marks), F.lit(None).cast(MARK), surer)


def upsert_marks(marks: DataFrame) -> DataFrame:
    """doc_id, idx, level, seq, section_type, conf, ...: of each place the surest mark; of equals the earliest. seq is that of the first."""
    fields = [F.col(c) if c in marks.columns else F.lit(None).alias(c) for c in ("idx", "level", "section_type", "name", "conf")]
    mark = F.struct(*fields, F.array().cast("array<string>").alias("evidence"), F.create_map().cast("map<string,string>").alias("flags")).cast(MARK)
    g = marks.groupBy("doc_id", "idx", "level").agg(F.min("seq").alias("seq"), F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(mark).alias("m")))), lambda x: F.from_json(x["m"], MARK)).alias("m"))
    return g.select("doc_id", "idx", "level", "seq", merged(F.col("m")).alias("m")).select("doc_id", "idx", "level", "seq", "m.section_type", "m.conf")


def last_before(on: Column, value: Column, window) -> Column:
    """The value of the last row of the window that has a property."""
    return F.last(F.when(on, value), ignorenulls=True).over(window)


def islands(rows: DataFrame, flag: str, out: str, of: Column | None = None) -> DataFrame:
    """Adds struct(start, last): of the run of rows with the flag and consecutive idx that a row is in, the first row that also has ``of`` and the
    last row. Rows without the flag have that of the run that follows them."""
    on = F.coalesce(F.col(flag), F.lit(False))
    order = Window.partitionBy("doc_id").orderBy("idx")
    parted = ~on | F.coalesce(F.lag("idx").over(order) != F.col("idx") - 1, F.lit(False))
    run = Window.partitionBy("doc_id", "__run_number")
    start, last = F.min(F.when(on if of is None else on & of, F.col("idx"))).over(run), F.max(F.when(on, F.col("idx"))).over(run)
    numbered = rows.withColumn("__parted", parted.cast("int")).withColumn("__run_number", F.sum("__parted").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn(out, F.struct(start.alias("start"), last.alias("last"))).drop("__parted", "__run_number")


def run_so_far(rows: DataFrame, flag: Column, of: Column, out: str) -> DataFrame:
    """Adds the first row with ``of`` of the run of rows with the flag and consecutive idx that a row is in, as far as the row; null before it and
    outside runs. All windows have the document's order, so rows are not sorted anew as in islands(), which also looks ahead."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    on = F.coalesce(flag, F.lit(False))
    begins = on & F.coalesce(of, F.lit(False))
    parted = ~on | F.coalesce(F.lag("idx").over(order) != F.col("idx") - 1, F.lit(False))
    df = rows.select("*", parted.alias("__parted"), F.max(F.when(begins, F.col("idx"))).over(before).alias("__begun"))
    df = df.withColumn("__parted_at", F.max(F.when(F.col("__parted"), F.col("idx"))).over(upto))
    new = begins & F.coalesce(F.col("__begun") < F.col("__parted_at"), F.col("__begun").isNull())
    df = df.withColumn("__begun", F.max(F.when(new, F.col("idx"))).over(upto))
    return df.withColumn(out, F.when(on & (F.col("__begun") >= F.coalesce("__parted_at", "__begun")), F.col("__begun"))).drop("__parted", "__begun", "__parted_at")


def longest_run(rows: DataFrame, flag: str) -> DataFrame:
    """doc_id, start, length: the longest run of consecutive idx with the flag; the first of equals."""
    runs = islands(rows, flag, "r").filter(F.col(flag)).select("doc_id", F.col("r.start").alias("start"), (F.col("r.last") - F.col("r.start") + 1).alias("length"))
    return runs.groupBy("doc_id").agg(F.max_by(F.struct("start", "length"), F.struct(F.col("length"), -F.col("start"))).alias("r")).select("doc_id", "r.*")


def leading_run(rows: DataFrame, flag: str, most: int) -> DataFrame:
    """doc_id, length: rows from the first on that have the flag, up to ``most``."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    first = rows.select("doc_id", F.row_number().over(w).alias("k"), F.collect_list(flag).over(w.rowsBetween(0, most - 1)).alias("a")).filter("k = 1")
    return first.select("doc_id", F.size(leading(F.col("a"), lambda x, _: x)).alias("length"))


def new_group(kind: Column, idx: Column, window) -> Column:
    """Whether a row begins a group: the row before is not its neighbour (idx one apart) or of another kind."""
    return F.coalesce((F.lag(kind).over(window) != kind) | (F.lag(idx).over(window) != idx - 1), F.lit(True))


def type_groups(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, grp, first, last, kind: neighbours (idx one apart) of one kind."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    marked = rows.withColumn("__n", new_group(F.col(kind), F.col("idx"), w).cast("int")).withColumn("grp", F.sum("__n").over(w))
    return marked.groupBy("doc_id", "grp").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.first(kind).alias(kind))


def without_overlaps(spans: Column) -> Column:
    """Spans (start, end): sorted by start, longer first; those that overlap a kept one go."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-(s["end"] - s["start"])).alias("n"), s["end"].alias("end")))
    first = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("kept"), F.lit(-1).alias("last"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when(s["start"] >= a["last"], F.struct(kept.alias("kept"), s["end"].alias("last"))).otherwise(a)

    return F.aggregate(F.array_sort(order), first, step, lambda a: a["kept"])


def stronger_later(rows: DataFrame, kind: str = "type", strength: Column | None = None, out: str = "later") -> DataFrame:
    """Adds out: whether a row of the same document and kind follows that is stronger. Read from the end, so that each row is one step."""
    strength = F.col("strength") if strength is None else strength
    w = Window.partitionBy("doc_id", kind).orderBy(F.desc("idx")).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.max(strength).over(w) > strength, F.lit(False)))


def _rounds(rows: DataFrame) -> int:
    """Doublings after which a pointer has passed every row of its document."""
    return int(rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1).bit_length()


def _leapt(pointers: DataFrame, rounds: int) -> DataFrame:
    """doc_id, id, at, open: pointers followed by doubling, at most 2 ** rounds steps; open where there is a further step."""
    p = pointers.withColumn("open", F.lit(True))
    for _ in range(rounds):
        far = p.select("doc_id", F.col("id").alias("at"), F.col("at").alias("far"))
        p = settle(p.join(far, ["doc_id", "at"], "left").select("doc_id", "id", F.coalesce("far", "at").alias("at"), F.col("far").isNotNull().alias("open")))
        if not p.filter("open").limit(1).count():
            break
    return p


def chain_ends(rows: DataFrame) -> DataFrame:
    """doc_id, id, duplicate_of: each pointer followed to the end of its chain, however long. A chain that runs into a loop ends at the
    first row of the loop that it meets, and a row of a loop at itself. Ids are unique within a document.

    Pointers double: the number of rounds is the logarithm of the longest chain; rounds with loops are bounded by the rows of a document."""
    pointers = settle(rows.filter("duplicate_of IS NOT NULL").select("doc_id", "id", F.col("duplicate_of").alias("at")))
    rounds = _rounds(pointers)
    ends = _leapt(pointers, rounds)
    if ends.filter("open").limit(1).count():
        loop = settle(ends.filter("open").select("doc_id", F.col("at").alias("id")).distinct())
        outside = _leapt(settle(pointers.join(loop, ["doc_id", "id"], "left_anti")), rounds)
        ends = outside.unionByName(loop.select("doc_id", "id", F.col("id").alias("at"), F.lit(False).alias("open")))
    return ends.select("doc_id", "id", F.col("at").alias("duplicate_of"))


def inherited(rows: DataFrame, id_: str, based_on: str, value: str) -> DataFrame:
    """doc_id, id and value: the first value that is not null up the chain of based_on, by doubling as in chain_ends(). Chains that end in
    a loop or at an unknown id without a value have none."""
    names = [F.col(id_).alias("id"), F.col(based_on).alias("at"), F.col(value).alias("v")]
    p = settle(rows.select("doc_id", *names))
    for _ in range(_rounds(p)):
        if not p.filter("v IS NULL AND at IS NOT NULL").limit(1).count():
            break
        up = p.select("doc_id", F.col("id").alias("at"), F.col("at").alias("far"), F.col("v").alias("w"))
        p = settle(p.join(up, ["doc_id", "at"], "left").select("doc_id", "id", F.when(F.col("v").isNull(), F.col("far")).alias("at"), F.coalesce("v", "w").alias("v")))
    return p.select("doc_id", F.col("id").alias(id_), F.col("v").alias(value))


def soft_lines(rows: DataFrame) -> DataFrame:
    """doc_id, line, text: runs (doc_id, run, text) parted at line ends and joined again by line."""
    parts = rows.select("doc_id", "run", F.posexplode(F.split("text", "\n")).alias("k", "part"))
    w = Window.partitionBy("doc_id").orderBy("run", "k")
    lines = parts.withColumn("line", F.sum((F.col("k") > 0).cast("int")).over(w))
    g = lines.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.struct("run", "k", "part"))).alias("p"))
    return g.select("doc_id", "line", F.array_join("p.part", "").alias("text"))
