"""Interaction of filters: what each would remove under every order of application.

A document's failures are one bit mask, so a corpus is a table of mask counts per part. Mask
matrix and inverse-permutation position matrix are combined by minimum (a product in the min-plus
semiring): the least position of a failed filter is the step that removes the mask under an order.
Counts are then scattered by that step, weighted by the documents of each mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices, texts

#: Filters by name, in the order of their bits. E needs the whole table, the others one text.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))
#: No step: nothing removes a mask without failures.
NEVER = 1 << 20
EFFECTS = "mask int, filter_order string, step int, part_kept int, part_removed int, part_redundant int, part_unique int, orders_removed int"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    n, distinct = 0, set()
    for part in slices(text):
        words = part.split()
        n += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def removal_steps(names: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters, the step of each filter in each order, and the removal step of
    each mask under each order (NEVER for the mask without failures)."""
    orders = list(permutations(range(len(names))))
    position = np.argsort(np.array(orders), axis=1) + 1  # inverse permutations
    bits = np.arange(1 << len(names))[:, None] >> np.arange(len(names)) & 1
    step = (np.where(bits == 1, 0, NEVER)[:, None, :] + position[None, :, :]).min(axis=2)
    return ["".join(names[k] for k in o) for o in orders], position, np.minimum(step, NEVER)


def effects(names: str = FILTERS) -> list[tuple]:
    """What one document of each mask adds to the counts of each order and step. The rows are
    2^k k! k for k filters, whatever the data: 19,200 for five."""
    orders, position, removed_at = removal_steps(names)
    out = []
    for mask in range(1 << len(names)):
        times = (removed_at[mask][:, None] == position).sum(axis=0)  # orders in which each filter removes it
        for o, order in enumerate(orders):
            for step, letter in enumerate(order, 1):
                f = names.index(letter)
                at = int(removed_at[mask, o])
                fails = mask >> f & 1
                out.append((mask, order, step, int(at > step), int(at == step), int(fails and at < step), int(mask == 1 << f), int(times[f])))
    return out


def failures(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n) of all rows, equal rows counted in n.

    Filter E fails rows whose text has a smaller id elsewhere, where a null id comes after all
    others. No row of a group of copies is sent to where its group is: the smallest id per text is
    a partial aggregate, and rows look for their own (text, id) among these.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            masks = pa.array([text_mask(t) for t in texts(f)], pa.int32())
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), f.column("part"), f.column("digest"), masks], schema=schema)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"),
    )
    facts = scratch.stage(rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int"), "facts")
    own = facts.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    same = own["digest"].eqNullSafe(first["digest"]) & own["doc_id"].eqNullSafe(first["doc_id"])
    mask = F.col("mask") + F.when(F.col("first").isNull(), COPY).otherwise(0)
    return own.join(first, same, "left").select(own["doc_id"], "part", mask.cast("int").alias("mask"), "n")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts per part, order of the five filters and step.

    Returns part, filter_order, step, filter, kept, removed, redundant (fails the step's filter,
    removed earlier), unique_fails (fails that filter alone), good_lost and toxic_lost (removed at the
    step and labelled so), and shapley (removed by that filter, summed over all orders). Every
    part has every order and step. A null part is the empty string; a null text is empty; null ids
    have no label and come last among copies; several labels of an id count where any says so;
    repeated rows count each and are no copies of each other, as their ids are equal; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "filter-audit")
    failed = scratch.stage(failures(docs, scratch, id_col, text_col, part_col), "masks")
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    zero = F.lit(0).cast("long")
    all_rows = failed.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    # An inner join: rows with a null id, however many, do not meet in one task.
    labelled = failed.join(flags, "doc_id").select("part", "mask", zero.alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    counts = scratch.stage(all_rows.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "counts")
    # 19,200 rows, fixed by the number of filters.
    table = F.broadcast(spark.createDataFrame(effects(), EFFECTS))
    total = lambda weight, part, name: F.sum(F.col(weight) * F.col(part)).cast("long").alias(name)
    return counts.join(table, "mask").groupBy("part", "filter_order", "step").agg(
        total("n", "part_kept", "kept"), total("n", "part_removed", "removed"), total("n", "part_redundant", "redundant"), total("n", "part_unique", "unique_fails"),
        total("good", "part_removed", "good_lost"), total("toxic", "part_removed", "toxic_lost"), total("n", "orders_removed", "shapley"),
    ).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
