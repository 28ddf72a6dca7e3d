"""Loop features of printed programs, as windows over typed lines.

Every line is an event: a loop or another scope opens, a scope ends, an
attribute is told, or a statement runs.  Running sums give its depth.  What is
open around a line at some depth is the last scope opened there before it, so a
statement asks once for every depth around it, and the answers are multiplied.
The lines of a program stay together after one shuffle; no program is larger
than the row its text came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfspark.runtime import materialize

# Operations that are counted, signs that stand for some of them,
# and the marks a loop can carry, by place.
OPERATIONS = ["add", "negative", "multiply", "divide", "sqrt", "expand_dims", "relu", "reshape", "allocate", "assign",
              "subtract", "exp", "concat", "batch_matmul_NT"]
SIGNS = {"+": "add", "-": "negative", "*": "multiply", "/": "divide"}
MARKS = ["none", "unroll", "vectorize", "parallel", "vthread", "blockIdx.x", "threadIdx.x", "blockIdx.y", "threadIdx.y",
         "blockIdx.z", "threadIdx.z", "tensorize"]
# Fixed patterns of the printed form.
RANGE = r"\([a-zA-Z\d._]+, (\d+), (\d+)\)"
BOUND = r"^// attr \[iter_var\(((?:block|thread)Idx\.[xyz]).* thread_extent = (\d+)"
LANES = r"ramp\([()a-zA-Z\d*+. ]+, \d+, (\d+)\)"
ACCESS = r"[a-zA-Z\d._]+\[[^\[\]=]+\]"

#: Bytes of the texts that a task takes (one text may be larger).
TASK_BYTES = 4 << 20

LOOP, SCOPE, BREAK, END, ATTRIBUTE, STATEMENT = "loop", "scope", "break", "end", "attribute", "statement"


def _number(line: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found.cast("double"))


def typed(line: Column) -> Column:
    """Kind of a trimmed line; null for lines that say nothing."""
    return (
        F.when(line == "", None)
        .when(line.startswith("//"), F.when(line.rlike(BOUND), ATTRIBUTE))
        .when(line.rlike("^(for|parallel|unrolled)") & line.rlike(RANGE), LOOP)
        .when(line.startswith("}"), END)
        .when(line.endswith("{"), SCOPE)
        .when(line.startswith("tir.tvm_thread_allreduce"), BREAK)
        .otherwise(STATEMENT)
    )


def performed(line: Column) -> Column:
    """Counted operations of a statement: a named call, an allocation, a copy,
    or the signs between the items on its right side."""
    value = F.when(F.instr(line, " = ") > 0, F.substring(line, F.instr(line, " = ") + 3, F.length(line))).otherwise("")
    signs = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    between = F.transform(F.split(F.regexp_replace(value, ACCESS, ""), ""), lambda c: F.element_at(signs, c))
    found = (
        F.when(line.startswith("T_") & ~line.startswith("T_matmul"), F.array(F.regexp_extract(line, r"^T_(\w*)", 1)))
        .when(line.startswith("allocate"), F.array(F.lit("allocate")))
        .when(line.rlike(f"^{ACCESS} = {ACCESS}"), F.array(F.lit("assign")))
        .otherwise(between)
    )
    return F.filter(found, lambda op: F.coalesce(op.isin(OPERATIONS), F.lit(False)))


def events(programs: DataFrame) -> DataFrame:
    """Typed lines of ``programs(row, text)``: row, at, kind,
    extent (of a loop or attribute), mark, lanes and operations."""
    lines = programs.select("row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.col("line")
    rows = lines.withColumn("line", F.btrim(line, F.lit(" \t\r\f\x0b"))).withColumn("kind", typed(line)).where("kind IS NOT NULL")
    is_loop, is_attribute, is_statement = (F.col("kind") == k for k in (LOOP, ATTRIBUTE, STATEMENT))
    extent = F.when(is_loop, _number(line, RANGE, 2) - _number(line, RANGE, 1) + 1).when(is_attribute, _number(line, BOUND, 2))
    own = F.when(line.startswith("parallel"), "parallel").when(line.startswith("unrolled"), "unroll")
    mark = F.when(is_loop, own).when(is_attribute, F.regexp_extract(line, BOUND, 1))
    return rows.select(
        "row", "at", "kind", extent.alias("extent"), mark.alias("mark"),
        F.when(is_statement, F.coalesce(_number(line, LANES, 1), F.lit(1.0))).alias("lanes"),
        F.when(is_statement, performed(line)).alias("operations"))


def nested(lines: DataFrame) -> DataFrame:
    """Events with ``level`` (the depth at which a scope opens or ends, else
    the number of scopes around the line) and ``marks``: per mark the product
    that the line carries itself.

    Attributes told one after the other belong together.  They mark the next
    loop and the statements before it, until another attribute, a loop, the end
    of a loop or a condition.
    """
    order = Window.partitionBy("row").orderBy("at")
    step = F.when(F.col("kind").isin(LOOP, SCOPE), 1).when(F.col("kind") == END, -1).otherwise(0)
    rows = lines.withColumn("sum", F.sum(step).over(order))
    # an end without a scope counts for nothing
    depth = F.col("sum") - F.least(F.lit(0), F.min("sum").over(order))
    rows = rows.withColumn("depth", depth)
    outside = F.coalesce(F.lag("depth").over(order), F.lit(0))
    rows = rows.withColumn("level", F.when(F.col("kind") == END, outside).otherwise(F.col("depth"))).where((F.col("kind") != END) | (F.col("level") > 0))
    opened = F.when(F.col("kind").isin(LOOP, SCOPE), F.col("kind"))
    before = Window.partitionBy("row", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ended", F.when(F.col("kind") == END, F.last(opened, ignorenulls=True).over(before)))
    rows = rows.where((F.col("kind") != END) | (F.col("ended") == LOOP))  # what else ends has no effect on marks

    attribute = F.col("kind") == ATTRIBUTE
    begins = attribute & F.coalesce(F.lag("kind").over(order) != ATTRIBUTE, F.lit(True))
    rows = rows.withColumn("run", F.sum(begins.cast("int")).over(order))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    told = F.max(F.when(attribute, F.col("at"))).over(past)
    taken = F.max(F.when(F.col("kind").isin(LOOP, SCOPE, BREAK, END), F.col("at"))).over(past)
    rows = rows.withColumn("waits", told > F.coalesce(taken, F.lit(-1)))
    run = Window.partitionBy("row", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    marks = []
    for name in MARKS:
        waiting = F.coalesce(F.product(F.when(attribute & (F.col("mark") == name), F.col("extent"))).over(run), F.lit(1.0))
        own = F.when((F.col("kind") == LOOP) & (F.col("mark") == name), F.col("extent")).otherwise(1.0)
        marks.append(F.when(F.coalesce("waits", F.lit(False)), waiting).otherwise(1.0) * own)
    return rows.withColumn("marks", F.array(*marks)).where(~attribute)


def scope_features(programs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Rows (other columns, op, loop_steps, loop_cnt, marks) of program texts:
    per operation of a program the summed steps (product of the loops around a
    statement, times its lanes), the summed number of loops around it, and per
    mark the summed products of the extents that carry it.

    A null text, or one without counted operations, gives no row; repeated
    programs each give theirs.
    """
    text = F.col(text) if isinstance(text, str) else text
    rest = [c for c in programs.columns if c != "text"]
    kept = materialize(programs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"), text.alias("text")).where("text IS NOT NULL"))
    # texts are dealt before they become lines, so that the lines of a task are bounded and stay where they are
    tasks = -(-(kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES)
    dealt = kept.select("row", "text").repartition(max(kept.sparkSession.sparkContext.defaultParallelism, tasks), "row")
    lines = nested(events(dealt))
    opens = F.col("kind").isin(LOOP, SCOPE)
    scope = F.when(opens, F.struct((F.col("kind") == LOOP).alias("loop"), "extent", "marks"))
    # one question for every depth, and at depth 0 what the statement has itself
    depths = F.when(opens, F.array("level")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("level")))
    asks = lines.where(opens | (F.size("operations") > 0)).select(
        "row", "at", F.explode(depths).alias("level"), scope.alias("scope"), "operations", "lanes", "marks")
    before = Window.partitionBy("row", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = asks.withColumn("around", F.last("scope", ignorenulls=True).over(before)).where("operations IS NOT NULL")
    itself = F.col("level") == 0
    factor = F.when(itself, F.col("lanes")).when(F.col("around.loop"), F.col("around.extent"))
    by_mark = [F.when(itself, F.col("marks")[i]).when(F.col("around.loop"), F.col("around.marks")[i]) for i in range(len(MARKS))]
    names = [f"mark{i}" for i in range(len(MARKS))]
    # sums and products of numbers alone are added up by hashing; a program's own columns come back at the end
    per_statement = found.groupBy("row", "at", "operations").agg(
        F.product(factor).alias("steps"), F.count(F.when(~itself & F.col("around.loop"), 1)).alias("loops"),
        *[F.product(m).alias(n) for n, m in zip(names, by_mark)])
    per_operation = per_statement.withColumn("op", F.explode("operations")).groupBy("row", "op").agg(
        F.sum("steps").alias("loop_steps"), F.sum("loops").alias("loop_cnt"), F.array(*[F.sum(n) for n in names]).alias("marks"))
    return per_operation.join(kept.select("row", "rest"), "row").select(
        *[F.col("rest")[c].alias(c) for c in rest], "op", "loop_steps", "loop_cnt", "marks")
