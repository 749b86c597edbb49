"""Operator 9: embedding near-dedup by a distributed cover tree and dual traversal.

Vectors are scaled to unit length, so that cosine >= c is a distance of at most r = sqrt(2 - 2c).  Equal vectors of a label are one
class with a weight.

The upper levels of a label's tree are made by Spark, level by level: a node of more than PART classes gets child centres (its classes of
lowest hash, as many as it has parts, FAN at most), its classes go to the nearest one, and each class also visits every later child that could hold a
vector within r of it, so that two classes meet once, where the later one of their paths leads.  Those are the children whose side of no bisector is
further than r away, and whose covering radius plus r reaches the class.
Both bounds are exact, so no link is lost; routing is a join on node ids, whose large nodes are dealt to tasks in salted parts.
In a leaf its own classes meet each other and the visitors.  There each side gets a cover tree, nested levels with halving radii, and a dual
traversal drops node pairs by their covering radii, takes node pairs that lie within r altogether without visiting their members, and verifies
the rest by the exact cosine.  A task returns counts of links and one member of each component, never pairs.

Defined results: rows with a null label and vectors that are null, zero, or hold a null or non-finite component link with nothing; equal
vectors link with each other; vectors of other lengths never link; repeated rows (equal ids) are vectors each; a null id never names a component
if another id is there; an empty table gives an empty table; columns other than id, vector and label are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, staged

#: Classes of a leaf of the distributed tree; children of a node; levels, after which large leaves are cut by hash; classes that visit a task; members of a leaf in a task.
PART, FAN, LEVELS, VISITORS, LEAF = 4096, 64, 12, 8192, 16
#: Classes of one cover tree of a task.
TREE = 1024
#: Slack of bounds against rounding.
EPS = 1e-7


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in double precision, by the largest component first, so that squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class CoverTree:
    """A cover tree of unit vectors.  A node covers a range of `order`; its children's centres are its members, each covering
    what lies within the level's radius and no earlier child covers; a level's radius is at most half of its parent's."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        centre, radius, self.span, self.child = [0], [self._reach(0, self.order)], [(0, len(x))], [(0, 0)]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.span[node]
            if b - a <= LEAF or radius[node] <= EPS:
                continue
            cover = 2.0 ** math.floor(math.log2(radius[node]) - 1e-9)
            cover = cover / 2 if cover > radius[node] / 2 else cover
            first = len(centre)
            for c, members in self._covered(self.order[a:b].copy(), cover):
                self.order[a : a + len(members)] = members
                centre.append(c)
                radius.append(self._reach(c, members))
                self.span.append((a, a + len(members)))
                self.child.append((0, 0))
                a += len(members)
            self.child[node] = (first, len(centre))
            todo.extend(range(first, len(centre)))
        self.centres, self.radii = x[centre], np.array(radius)

    def _reach(self, c: int, members: np.ndarray) -> float:
        away = self.x[members] - self.x[c]
        return float(np.sqrt((away * away).sum(axis=1).max()))

    def _covered(self, members: np.ndarray, cover: float) -> Iterator[tuple[int, np.ndarray]]:
        points, left = self.x[members], np.arange(len(members))
        near = 2 - 2 * points @ points.T <= cover * cover  # a tree has TREE members at most
        np.fill_diagonal(near, True)
        while len(left):
            own = near[left[0], left]
            yield int(members[left[0]]), members[left[own]]
            left = left[~own]

    def members(self, node: int) -> np.ndarray:
        return self.order[slice(*self.span[node])]

    def below(self, node: int) -> np.ndarray:
        """The node's children, or itself if it is a leaf."""
        a, b = self.child[node]
        return np.arange(a, b) if a != b else np.array([node])


def dual_traversal(s: CoverTree, t: CoverTree, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Blocks (members of s, members of t, which pairs are links; None for all) that together hold every pair of cosine >= least.

    With s the same tree as t, each pair comes once, but for a node with itself, whose block is square and symmetric.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    same = s is t
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        u, v = s.below(i), t.below(j)
        d = np.sqrt(np.maximum(0, 2 - 2 * s.centres[u] @ t.centres[v].T))
        both = s.radii[u][:, None] + t.radii[v]
        near = d <= both + reach + EPS
        if same and i == j:
            near &= np.tri(len(u), dtype=bool).T
        for a, b in np.argwhere(near).tolist():
            m, n = int(u[a]), int(v[b])
            if d[a, b] + both[a, b] <= reach - EPS:
                yield s.members(m), t.members(n), None
            elif s.child[m] == t.child[n] == (0, 0):
                p, q = s.members(m), t.members(n)
                hit = s.x[p] @ t.x[q].T >= least
                if hit.any():
                    yield p, q, hit
            else:
                todo.append((m, n))


def linked(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked weight of each of x, that of each of y, component of each of both) of links between x and y, whose weights are of_x and of_y.

    Components are numbered by a member's place, y after x.  Both are cut into trees of TREE members.
    """
    count, other, root = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.arange(len(x) + len(y))
    ends: list[np.ndarray] = []
    trees = [[(at, CoverTree(z[at : at + TREE])) for at in range(0, len(z), TREE)] for z in (x, y)]
    for (i, s), (j, t) in itertools.product(*trees):
        for a, b, hit in dual_traversal(s, t, least):
            a, b = a + i, b + j
            if hit is None:
                count[a] += of_y[b].sum()
                other[b] += of_x[a].sum()
                both = np.concatenate([a, b + len(x)])
                ends.append(np.stack([both, np.full(len(both), a[0])]))
            else:
                count[a] += hit @ of_y[b]
                other[b] += of_x[a] @ hit
                p, q = np.nonzero(hit)
                ends.append(np.stack([a[p], b[q] + len(x)]))
    if ends:
        u, v = np.concatenate(ends, axis=1)
        while True:  # least label of neighbours, then of the label's own label
            before = root.copy()
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if np.array_equal(root, before):
                break
    return count, other, root


def visits(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centre of each of x, which centres' cells may hold a vector within reach of it, distances to all centres).

    A cell lies on its centre's side of every bisector, so it is out of reach if the bisector with some other centre is further than that.
    """
    square = np.maximum(0, 2 - 2 * x @ centres.T)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    nearest = square.argmin(axis=1)
    may = square - square[np.arange(len(x)), nearest][:, None] <= 2 * reach * apart[nearest] + EPS
    for i in range(len(centres)):  # the bisectors with all other centres
        may &= square - square[:, i : i + 1] <= 2 * reach * apart[i] + EPS
    may[np.arange(len(x)), nearest] = True
    return nearest, may, np.sqrt(square)


def _rows(part: pd.DataFrame, column: str = "vector") -> np.ndarray:
    return np.stack(part[column].to_numpy())


def _routed(classes: DataFrame, reach: float) -> DataFrame:
    """(node, home, class, weight, vector): each class in its leaf (home) and in those that it visits."""
    vector = classes.schema["vector"].dataType.simpleString()
    schema = f"node string, home boolean, away double, class long, weight long, vector {vector}"
    rows = classes.select(F.col("kind").alias("node"), F.lit(True).alias("home"), F.lit(0.0).alias("away"), "class", "weight", "vector")
    done: list[DataFrame] = []

    def routed(own: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(centres):
            return pd.DataFrame(columns=["node", "home", "away", "class", "weight", "vector"])
        centres = centres.sort_values("child")
        nearest, may, away = visits(unit(_rows(own)), unit(_rows(centres)), reach)
        at_home = own["home"].to_numpy()
        may &= (np.arange(len(centres)) >= nearest[:, None]) | ~at_home[:, None]  # earlier children's classes visit here
        i, j = np.nonzero(may)
        out = own[["class", "weight", "vector"]].iloc[i]
        names = np.array([f"{own['node'].iloc[0]}.{c}" for c in centres["child"]], object)
        home = at_home[i] & (nearest[i] == j)
        return out.assign(node=names[j], home=home, away=away[i, j])[["node", "home", "away", "class", "weight", "vector"]]

    for _ in range(LEVELS):
        sizes = staged(rows.groupBy("node").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n")), "vectors")
        sizes = sizes.where(f"homes > {PART}")
        if sizes.isEmpty():
            break
        split = rows.join(sizes, "node")
        done.append(rows.join(sizes, "node", "left_anti"))
        drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("class"), "class"))
        few = split.where("home").withColumn("child", drawn).where(F.col("child") <= FAN).where(F.col("child") <= F.ceil(F.col("homes") / PART))
        salts = F.ceil(F.col("n") / VISITORS).cast("int")
        centres = staged(few.select("node", "child", "vector", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "vectors")
        dealt = split.select("node", "home", "class", "weight", "vector", F.pmod(F.xxhash64("class"), salts).cast("int").alias("salt"))
        below = staged(dealt.groupBy("node", "salt").cogroup(centres.groupBy("node", "salt")).applyInPandas(routed, schema), "vectors")
        radius = staged(below.where("home").groupBy("node").agg(F.max("away").alias("radius")), "vectors")  # a child without classes of its own has none
        rows = below.join(radius, "node").where(F.col("home") | (F.col("away") <= F.col("radius") + reach + EPS)).drop("radius")
    for more in done:
        rows = rows.union(more.select(*rows.columns))
    return rows.drop("away")


def _met(leaves: DataFrame, least: float) -> DataFrame:
    """(class, n, root): linked weight of each class in a leaf, and for all classes with a link a member of their component there."""
    sizes = staged(leaves.groupBy("node").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n")), "vectors")
    parts, others = F.ceil(F.col("homes") / TREE).cast("int"), F.ceil(F.col("n") / VISITORS).cast("int")  # a tree of its own classes a task
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "class"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    joined = leaves.join(sizes, "node").where("homes > 0")
    here = joined.where("home").select("node", place(parts, 1).alias("i"), each(others).alias("j"), F.lit(True).alias("own"), "home", "class", "weight", "vector")
    there = joined.select("node", each(parts).alias("i"), place(others, 2).alias("j"), F.lit(False).alias("own"), "home", "class", "weight", "vector")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        own, other = rows[rows["own"]], rows[~rows["own"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"class": [], "n": [], "root": []})
        a, b, of_a, of_b = own["class"].to_numpy(), other["class"].to_numpy(), own["weight"].to_numpy(), other["weight"].to_numpy()
        count, back, place = linked(unit(_rows(own)), unit(_rows(other)), of_a, of_b, least)
        met = np.isin(a, b)
        count[met] -= of_a[met]  # a class has met itself
        back[other["home"].to_numpy()] = 0  # the leaf's own classes count as such
        ids, n = np.concatenate([a, b]), np.concatenate([count, back])
        root = ids[place]
        some = (n > 0) | (root != ids)
        return pd.DataFrame({"class": ids[some], "n": n[some], "root": root[some]})

    # a leaf's parts are dealt to tasks apart from each other
    return here.union(there).repartition("node", "i", "j").groupBy("node", "i", "j").applyInPandas(compared, "class long, n long, root long")


def near_links(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component) of every vector: others linked directly, and the smallest id reachable by links."""
    v = F.col("vector")
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("kind", F.when(F.coalesce(finite, F.lit(False)), F.concat_ws(":", F.size(v), "label")))
    rows = rows.withColumn("kind", F.when(F.col("label").isNotNull(), F.col("kind"))).drop("label")
    classes = rows.where("kind is not null").groupBy("kind", "vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")

    leaves = _routed(classes, math.sqrt(2 - 2 * least))
    found = staged(_met(leaves, least), "vectors")
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    n = found.groupBy("class").agg(F.sum("n").alias("n"))
    named = staged(
        classes.drop("vector").join(n, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")),
        "vectors",
    )
    low = named.groupBy("root").agg(F.min("low").alias("component"))
    of = classes.select("kind", "vector", "class").join(named.join(low, "root").select("class", "n_links", "component"), "class").drop("class")
    out = rows.join(of, ["kind", "vector"], "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")
    )


def op9(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = near_links(vectors).withColumnRenamed("component", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP9_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
v AS (SELECT rid, vec_id, label, list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: b * b)))) AS u FROM e
      WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
l AS (SELECT a.rid AS i, b.rid AS j, b.vec_id FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.u) = len(b.u)
      WHERE list_dot_product(a.u, b.u) >= 0.98),
r AS (SELECT rid AS i, rid AS j, vec_id FROM e UNION SELECT r.i, l.j, l.vec_id FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(vec_id) AS component_id FROM r GROUP BY i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, coalesce(e.vec_id = component_id, false) AS kept
FROM e JOIN c ON c.i = e.rid LEFT JOIN n ON n.i = e.rid
"""
