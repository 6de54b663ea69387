"""Connected components by minimum labels and pointer jumping on a contracted graph, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.storage import Scratch


def _jump(parents: DataFrame, times: int) -> DataFrame:
    """Each vertex with its parent's parent, ``times`` over."""
    jumped = parents
    for i in range(times):
        up = parents.select(F.col("v").alias(f"u{i}"), F.col("label").alias(f"to{i}"))
        jumped = jumped.join(up, jumped["label"] == up[f"u{i}"]).select("v", F.col(f"to{i}").alias("label"))
    return jumped


def _written(edges: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, int]:
    """The edges, written, and their number."""
    table, (count, _) = scratch.write_counted(edges, label, "a")
    return table, count


def minimum_labels(edges: DataFrame, scratch: Scratch, jumps: int = 2, name: str = "cc") -> DataFrame:
    """v and label of every vertex of ``edges`` (a BIGINT, b BIGINT): equal labels just within a component.

    Each round gives a vertex the least label among its own and its neighbours', jumps along the labels, and replaces
    the edges by edges between labels; edges within a label vanish. It ends when no edge is left, as no label could
    change then. The least is taken by a grouped minimum, combined before the shuffle, so a vertex with a third of all
    edges costs one row a task. A loop a = b yields its vertex with its own label.
    """
    lower = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropna().distinct()
    edges, left = _written(lower, scratch, f"{name}-edges-0")
    rounds: list[DataFrame] = []
    while left or not rounds:
        k = len(rounds)
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        least = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label"))  # one exchange, reused by the jumps
        parents = scratch.write(_jump(least, jumps), f"{name}-parents-{k}")
        rounds.append(parents)
        a, b = (parents.select(F.col("v").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
        edges = edges.where("a <> b").join(a, "a").join(b, "b").where("la <> lb")
        edges = edges.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        edges, left = _written(edges, scratch, f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}")
    labels = rounds[0]
    for k, later in enumerate(rounds[1:]):
        up = later.select(F.col("v").alias(f"u{k}"), F.col("label").alias(f"to{k}"))
        labels = labels.join(up, labels["label"] == up[f"u{k}"], "left").select("v", F.coalesce(f"to{k}", "label").alias("label"))
    return labels


def _number(k: int, name: Column | str) -> Column:
    """The 64-bit number that the k-th hash gives an id."""
    return F.xxhash64(F.lit(k), name)


class Numbers:
    """Ids and their numbers: ``table`` has id and v, and no two ids share a v."""

    def __init__(self, table: DataFrame, odd: DataFrame | None):
        self.table = table
        self._odd = odd

    def apply(self, rows: DataFrame, name: str, number: str) -> DataFrame:
        """``rows`` with the number of the id in column ``name`` instead of it. Without collisions no join is needed."""
        rest = [c for c in rows.columns if c != name]
        if self._odd is None:
            return rows.select(*rest, _number(0, name).alias(number))
        odd = self._odd.select(F.col("id").alias(name), F.col("v").alias("_odd"))
        return rows.join(odd, name, "left").select(*rest, F.coalesce("_odd", _number(0, name)).alias(number))


def numbered(ids: DataFrame, scratch: Scratch, name: str = "ids") -> Numbers:
    """Numbers of all ids of the column ``id``.

    An id's number is a hash of it. Where ids collide, all but the least of them get a number from the next hash, until
    no two share one; about n * n / 2 ** 65 of n ids do, and a join over those alone looks their numbers up.
    """
    table = scratch.write(ids.select("id").dropna().distinct().select("id", _number(0, "id").alias("v")), f"{name}-0")
    k = 0
    while True:
        twice = table.groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("v", "first")
        if twice.isEmpty():
            break
        k += 1
        other = F.when(F.col("first") < F.col("id"), _number(k, "id")).otherwise(F.col("v"))
        table = scratch.write(table.join(twice, "v", "left").select("id", other.alias("v")), f"{name}-{k}")
    odd = table.where(F.col("v") != _number(0, "id")) if k else None
    return Numbers(table, odd)


def connected_components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """id and root (the least id of its component) of every node of ``edges`` (a, b of one ordered type).

    Null ends are dropped; a loop yields its node alone. The rounds run on 64-bit numbers and on edges between components
    only, so ids are read twice, at the start and at the end.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    clean = edges.select("a", "b").dropna()
    numbers = numbered(clean.select(F.explode(F.array("a", "b")).alias("id")), scratch, f"{name}-ids")
    numbered_edges = numbers.apply(numbers.apply(clean, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = minimum_labels(numbered_edges, scratch, name=name)
    named = scratch.write(labels.join(numbers.table, "v").select("label", "id"), f"{name}-labels")
    roots = named.groupBy("label").agg(F.min("id").alias("root"))
    return named.join(roots, "label").select("id", "root")
