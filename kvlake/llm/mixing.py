"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``most`` copies whose odds r / (most - r) are tilted
exponentially in its size, exp(lambda * size / mean): of all rates that meet the sources' word
targets these lie closest, in (Fermi) entropy, to half of ``most`` for all. The dual in the lambdas is
convex; it is solved by distributed Newton iterations, each one aggregation over the counts of
(source, size), which hold the same sums as the documents and are far fewer. Each lambda stays in a
bracket, so the iteration can't diverge. Rates become whole copies by error diffusion from the
largest document to the smallest, in salted blocks of bounded size; what is left over in a block is
mended by single changes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, named

WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: dict[str | None, int], share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> dict[str | None, float]:
    """share of all sizes, dealt by weight (repeating in code point order, null last); none gets over
    most times its size, what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        w = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / w > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / w for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _with(rows: DataFrame, **facts: dict) -> DataFrame:
    """rows with a column for each fact about their source. The facts have one row per source, max_sources
    at most, and are broadcast."""
    spark, order = rows.sparkSession, sorted({s for f in facts.values() for s in f}, key=lambda s: (s is None, s or ""))
    kinds = {"tilt": pa.float64(), "goal": pa.float64(), "blocks": pa.int64(), "source_size": pa.int64()}
    table = spark.createDataFrame(pa.table({"__of": pa.array(order, pa.string())} | {name: pa.array([f[s] for s in order], kinds[name]) for name, f in facts.items()}))
    return rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["__of"])).drop("__of")


def _rate(most: float) -> F.Column:
    """The rate of a row with its source's tilt (per word); without one, most."""
    return F.when(F.col("tilt").isNotNull(), F.lit(most) / (1 + F.exp(-F.col("tilt") * F.col("size")))).otherwise(F.lit(most))


def solve(counts: DataFrame, sizes: dict, n: dict, goal: dict, most: float) -> dict:
    """The tilt per word of each source, None where every document is taken as often as it may be. counts: source, size, n.
    Sums are exact decimals of the rows' terms, so their order and with it the partitions decide nothing."""
    mean = {s: max(1e-9, sizes[s] / n[s]) for s in sizes}
    lam = {s: math.inf if goal[s] >= most * sizes[s] * (1 - 1e-9) else 0.0 for s in sizes}
    open_, low, high = {s for s, v in lam.items() if v == 0.0}, dict.fromkeys(lam, -60.0), dict.fromkeys(lam, 60.0)
    r, exact = _rate(most), lambda x: F.sum(x.cast("decimal(38,6)"))

    def tilts() -> dict:
        return {s: v / mean[s] if math.isfinite(v) else None for s, v in lam.items()}

    for _ in range(60):
        if not open_:
            break
        got = _with(counts, tilt=tilts()).withColumn("r", r).withColumn("words", F.col("n") * F.col("size")).groupBy("source").agg(exact(F.col("words") * F.col("r")).alias("g"), exact(F.col("words") * F.col("size") * F.col("r") * (1 - F.col("r") / most)).alias("h")).collect()
        for row in got:
            s = row["source"]
            if s not in open_:
                continue
            gap, slope = float(row["g"]) - goal[s], float(row["h"])
            if abs(gap) <= 1e-6 * goal[s]:
                open_.discard(s)
                continue
            low[s], high[s] = (low[s], lam[s]) if gap > 0 else (lam[s], high[s])
            step = lam[s] - gap / (slope / mean[s]) if slope > 0 else math.nan
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-13:
                open_.discard(s)
    return tilts()


def _round(most: float):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        sizes, copies, err = pdf["size"].to_numpy(), [], 0.0
        for size, rate in zip(sizes.tolist(), pdf["rate"].tolist()):
            want = rate * size + err
            c = int(min(most, max(0, round(want / size)))) if size else 1
            err = want - c * size if size else err
            copies.append(c)
        copies = np.array(copies, np.int32)
        for _ in range(64):  # what is left over: the one change of one document that mends most of it
            room = copies < most if err > 0 else copies > 0
            miss = np.where(room & (sizes > 0), np.abs(abs(err) - sizes), np.inf)
            k = int(miss.argmin())
            if miss[k] >= abs(err):
                break
            copies[k] += 1 if err > 0 else -1
            err -= sizes[k] if err > 0 else -sizes[k]
        return pdf.assign(copies=copies)[["ident", "source", "size", "copies"]]

    return block


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, block_rows: int = 2_000, max_sources: int = 100_000) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies.

    Size: words of the text (null: 0). copies is 0, 1 or 2 (most), taken = copies * size. A document
    without words has taken 0 and one copy. Null is a source of its own. Rows that repeat are rounded
    each by itself. Equal input rows give equal output whatever the partitions. More sources than
    max_sources, the bound on what the driver keeps and broadcasts (at 100,000 some 10 MB), is an error. Other columns are not read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(named(id_col).alias("ident"), named(source_col).alias("source"), F.coalesce(F.regexp_count(named(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = scratch.save(rows, "rows")
    counts = scratch.save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    by = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(by) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes, n = {r["source"]: r["size"] for r in by}, {r["source"]: r["n"] for r in by}
    goal = targets(sizes, share, most, weights)
    tilt = solve(counts, sizes, n, goal, most)
    blocks = {s: -(-c // block_rows) for s, c in n.items()}
    rated = _with(rows, tilt=tilt, blocks=blocks).withColumn("rate", _rate(most)).withColumn("h", F.xxhash64("ident"))
    rated = rated.withColumn("salt", F.pmod(F.xxhash64(F.lit(11), "h"), F.col("blocks"))).select("ident", "source", "size", "rate", "h", "salt")
    ident_type = rows.schema["ident"].dataType.simpleString()
    done = rated.groupBy("source", "salt").applyInPandas(_round(most), f"ident {ident_type}, source string, size long, copies int")
    return _with(done, source_size=sizes, goal=goal).select(
        F.col("ident").alias(id_col),
        "size",
        "source_size",
        F.col("goal").alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).alias("copies"),
    )


def copies_of(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns. Of rows that share an
    id, each follows the mix's mean for that id, rounded up."""
    take = mixed.groupBy(named(id_col).alias("of")).agg(F.ceil(F.avg("copies")).cast("int").alias("copies"))
    whole = docs.select(named(id_col).alias("ident"), F.struct("*").alias("row"))
    joined = whole.join(take, whole["ident"].eqNullSafe(take["of"]))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
