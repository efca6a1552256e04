"""A quadtree over points as a table, and nearest neighbours with a certificate.

A square of over ``LEAF`` different points is cut into ``4**STEP`` squares, and so on down to ``4**LEVELS``. A node
is a row: level, place, number of points and their tight box. Leaves are small wherever the points crowd, so what
meets in a leaf is bounded, and a lookup costs the depth of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import stored

LEVELS, STEP, LEAF = 24, 2, 32
NODE = ["level", "cx", "cy"]


class Tree:
    """The quadtree of ``targets`` (``target, tx, ty``): of targets at one place the smallest stands for all."""

    def __init__(self, targets: DataFrame, leaf: int = LEAF):
        usable = targets.where(_number("tx") & _number("ty"))
        self.places = stored(usable.groupBy("tx", "ty").agg(F.min("target").alias("target")), "places")
        x0, x1, y0, y1 = self.places.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
        self.empty = x0 is None
        if self.empty:
            return
        self.x0, self.y0, self.side = x0, y0, max(x1 - x0, y1 - y0) or 1.0
        nodes = self._ancestors(self.places, "tx", "ty").groupBy(*NODE).agg(
            F.count("*").alias("n"), F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1")
        )
        full = (F.col("n") > leaf) & (F.col("level") < LEVELS)
        nodes = stored(nodes, "squares")
        above = nodes.where(full).select((F.col("level") + STEP).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        up = lambda c: F.shiftright(c, STEP)
        below = nodes.withColumn("px", up("cx")).withColumn("py", up("cy")).join(above, ["level", "px", "py"], "left_semi")
        self.nodes = stored(nodes.where("level = 0").withColumn("px", F.lit(0).cast("long")).withColumn("py", F.lit(0).cast("long")).unionByName(below).withColumn("leaf", ~full), "tree")
        self.leaves = self.nodes.where("leaf")
        self.held = stored(self._ancestors(self.places, "tx", "ty").join(self.leaves.select(*NODE), NODE), "leaves")

    def _fine(self, c: str, low: float) -> Column:
        at = F.floor((F.col(c) - low) / self.side * 2**LEVELS)
        return F.greatest(F.lit(0), F.least(F.lit(2**LEVELS - 1), at)).cast("long")

    def _ancestors(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """Each point once for each level, with the square it falls into; points outside fall into the nearest one."""
        levels = F.explode(F.array(*[F.lit(k) for k in range(0, LEVELS + 1, STEP)]))
        rows = points.withColumn("level", levels)
        up = lambda c, low: F.call_function("shiftright", self._fine(c, low), F.lit(LEVELS) - F.col("level"))
        return rows.withColumn("cx", up(x, self.x0)).withColumn("cy", up(y, self.y0))

    def _side(self) -> Column:
        return F.lit(float(self.side)) / F.pow(F.lit(2.0), F.col("level"))

    def own(self, points: DataFrame) -> DataFrame:
        """The nearest target in the leaf that a point falls into (``id, x, y, far, target``), and whether it is ``sure``.

        It is if no target of another leaf can be as near: all of them lie beyond the leaf's border.
        """
        met = self._ancestors(points, "x", "y").join(self.held, NODE)
        side = self._side()
        left, low = F.lit(float(self.x0)) + F.col("cx") * side, F.lit(float(self.y0)) + F.col("cy") * side
        border = F.least(F.col("x") - left, left + side - F.col("x"), F.col("y") - low, low + side - F.col("y")) - 1e-9 * self.side
        best = met.withColumn("far", distance()).withColumn("border", border).groupBy("id").agg(F.min(F.struct("far", "target")).alias("m"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("border").alias("border"))
        return best.select("id", "x", "y", "m.far", "m.target", (F.col("m.far") < F.col("border")).alias("sure"))

    def near(self, points: DataFrame) -> DataFrame:
        """``(id, x, y, level, cx, cy)``: the leaves that can hold the nearest target of a point (``id, x, y, most``).

        Level by level: every square holds a target within the far corner of its tight box, so squares whose
        near side lies beyond the smallest of these bounds, or beyond ``most``, are left out.
        """
        box = ["x0", "x1", "y0", "y1", "leaf"]
        dx = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0))
        dy = F.greatest(F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), F.lit(0.0))
        wide = F.greatest(F.abs(F.col("x") - F.col("x0")), F.abs(F.col("x") - F.col("x1")))
        high = F.greatest(F.abs(F.col("y") - F.col("y0")), F.abs(F.col("y") - F.col("y1")))
        at = points.select("id", "x", "y", "most", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
        at = at.join(self.nodes.select(*NODE, *box), NODE)
        done = None
        while True:
            bound = F.min(F.least("most", F.hypot(wide, high))).over(Window.partitionBy("id"))
            # a hair more, so that rounding never drops a square that holds a tie
            at = stored(at.withColumn("most", bound).where(F.hypot(dx, dy) <= F.col("most") * (1 + 1e-12)), "frontier")
            found = at.where("leaf").select("id", "x", "y", "most", *NODE, *box[:4])
            done = found if done is None else done.unionByName(found)
            inner = at.where("NOT leaf")
            if inner.isEmpty():
                break
            children = self.nodes.select(*NODE, "px", "py", *box)
            parents = inner.select("id", "x", "y", "most", (F.col("level") + STEP).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
            at = parents.join(children, ["level", "px", "py"]).drop("px", "py")
        least = F.min("most").over(Window.partitionBy("id"))
        return done.withColumn("most", least).where(F.hypot(dx, dy) <= F.col("most") * (1 + 1e-12)).select("id", "x", "y", *NODE)

    def met(self, points: DataFrame) -> DataFrame:
        """Points (``id, x, y, most``) with every target of the leaves that can hold their nearest."""
        return self.near(points).join(self.held, NODE)

    def nearest(self, points: DataFrame) -> DataFrame:
        """``(id, distance, target)`` of points (``id, x, y``) that have a place.

        A point's own leaf gives a first answer, which is final if it is nearer than the leaf's border. All others go
        down the tree from its root with that answer as a bound. Pairs that meet are at most a leaf for each looked at.
        """
        usable = points.select("id", "x", "y").where(_number("x") & _number("y"))
        own = stored(self.own(usable), "own-leaf")
        sure = own.where("sure").select("id", F.col("far").alias("distance"), "target")
        rest = usable.join(sure, "id", "left_anti").join(own.select("id", F.col("far").alias("most")), "id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        best = self.met(rest).groupBy("id").agg(F.min(F.struct(distance().alias("far"), "target")).alias("m")).select("id", F.col("m.far").alias("distance"), "m.target")
        return sure.unionByName(best)


def _number(c: str) -> Column:
    """Neither missing nor infinite."""
    return F.coalesce(F.col(c) - F.col(c) == 0, F.lit(False))


def distance() -> Column:
    return F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """``points`` (``id, x, y``; ids distinct) with the nearest target and its ``distance`` (ties: smallest target); NULL where there is none.

    Points and targets without a finite place have no nearest and are none.
    """
    tree = Tree(targets)
    if tree.empty:
        return points.withColumn("distance", F.lit(None).cast("double")).withColumn("target", F.lit(None).cast(targets.schema["target"].dataType))
    return points.join(tree.nearest(points), "id", "left")
