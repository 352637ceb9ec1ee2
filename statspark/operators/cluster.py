"""k-means and density clustering."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW_ID, Chart, Metric, Result, Table, data_error
from ..plans.cores import moments
from ..plans.features import Design, complete, design
from ..plans.registry import BOTH, DISCRETE, NUMERIC, QUANTITATIVE, Constraint, Run, Slot, operator
from ..plans.storage import settled

MODULE = "clustering_models"
#: Values of the rows that tasks hold at once for the silhouette, rows a task looks up, and rows and held rows of one step of it, which fit a core's cache.
HELD_VALUES, TASK_ROWS, STEP_ROWS, STEP_HELD = 4_000_000, 2048, 128, 512
CHART_ROWS = 1000


def scaled_features(df: DataFrame, made: Design, standardize: bool) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows as arrays of scaled features, with the centre and scale used."""
    found = moments(df, made.columns)
    if (np.diag(found.cross) <= 0).any():
        raise data_error("a column is constant", columns=[n for n, v in zip(made.names, np.diag(found.cross), strict=True) if v <= 0])
    centre = found.mean if standardize else np.zeros(len(made.names))
    scale = np.sqrt(np.diag(found.cross) / found.n) if standardize else np.ones(len(made.names))
    cells = [((c - F.lit(float(m))) / F.lit(float(s))) for c, m, s in zip(made.columns, centre, scale, strict=True)]
    return df.select(ROW_ID, F.array(*cells).alias("x")), centre, scale


def silhouette(points: DataFrame, k: int, query_rows: int | None = None) -> float | None:
    """Mean Euclidean silhouette of all (x, label) rows, at most ``k`` labels. Slabs of at most ``query_rows`` rows, by row hash, go to all tasks one after the other; each row adds up its distances where it is, so only rows are dealt out."""
    import pandas as pd

    sizes = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = np.array(sorted(sizes))
    if len(names) < 2:
        return None
    size = np.array([sizes[v] for v in names], float)
    n = int(size.sum())
    width = len(points.select("x").first()[0])
    slabs = -(-n // max(1, query_rows or HELD_VALUES // width))
    slab = F.pmod(F.xxhash64(ROW_ID), F.lit(slabs))
    state = points.select(ROW_ID, "x", "label", F.array().cast("array<double>").alias("d")).repartition(max(1, -(-n // TASK_ROWS)), ROW_ID)

    def added(b: pd.DataFrame, held: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = np.array(b["x"].tolist(), float).reshape(len(b), width)
        before = np.array(b["d"].tolist(), float).reshape(len(b), -1)
        d = before if before.size else np.zeros((len(b), len(names)))
        for at in range(0, len(x), STEP_ROWS):
            for c in range(len(names)):
                for start in range(ends[c], ends[c + 1], STEP_HELD):
                    d[at : at + STEP_ROWS, c] += _distances(x[at : at + STEP_ROWS], held[:, start : min(start + STEP_HELD, ends[c + 1])]).sum(1)
        return d

    def scores(b: pd.DataFrame, d: np.ndarray) -> np.ndarray:
        own, rows = np.searchsorted(names, b["label"].to_numpy()), np.arange(len(b))
        inside = d[rows, own] / np.maximum(size[own] - 1, 1)
        other = d / size
        other[rows, own] = np.inf
        near = other.min(1)
        most = np.maximum(near, inside)
        return np.where((size[own] > 1) & (most > 0), (near - inside) / np.where(most > 0, most, 1.0), 0.0)

    total = 0.0
    for i in range(slabs):
        local = points.where(slab == i).select("label", *(F.get("x", j).alias(f"x{j}") for j in range(width))).toArrow()
        label = local.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        held = np.array([local.column(f"x{j}").to_numpy()[order] for j in range(width)])
        shared = points.sparkSession.sparkContext.broadcast((held, np.searchsorted(label[order], [*names, names[-1] + 1])))
        last = i == slabs - 1

        def step(batches, shared=shared, last=last):
            for b in filter(len, batches):
                d = added(b, *shared.value)
                yield pd.DataFrame({"s": [float(scores(b, d).sum())]}) if last else b.assign(d=list(d))

        if last:
            total = state.mapInPandas(step, "s double").agg(F.sum("s")).first()[0]
        else:
            state = settled(state.mapInPandas(step, state.schema))
        shared.destroy()
    return total / n


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to columns; of few dimensions by differences, else by products."""
    if len(b) <= 4:
        square = np.subtract(a[:, 0, None], b[0])
        square *= square
        for i in range(1, len(b)):
            gap = np.subtract(a[:, i, None], b[i])
            gap *= gap
            square += gap
    else:
        square = a @ b
        square *= -2
        square += (a * a).sum(1)[:, None]
        square += (b * b).sum(0)
        np.maximum(square, 0, out=square)
    return np.sqrt(square, out=square)


def _labelled(run: Run, labels: DataFrame) -> DataFrame | None:
    if not run.params["generate_label_column"]:
        return None
    name = run.new_name(run.params["label_column_name"])
    return run.df.join(labels.select(ROW_ID, F.col("label").cast("long").alias(name)), ROW_ID, "left").drop(ROW_ID)


def _counts(labels: DataFrame) -> list[dict[str, Any]]:
    return [{"cluster": int(r["label"]), "sample_count": r["n"]} for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()]


def _projection(points: DataFrame) -> Chart:
    rows = points.orderBy(ROW_ID).limit(CHART_ROWS).select("x", "label").collect()
    return Chart("cluster_projection", "scatter", [[float(r["x"][0]), float(r["x"][1]) if len(r["x"]) > 1 else 0.0, int(r["label"])] for r in rows])


def _warn(result: Result, dropped: int, width: int) -> None:
    if dropped:
        result.warn("MISSING_ROWS_DROPPED", "rows with missing values were dropped", count=dropped)
    if width > 20:
        result.warn("HIGH_DIMENSION_DISTANCE", "distances say little in so many dimensions", dimensions=width)


_LABEL = {"generate_label_column": {"type": "boolean", "default": True}}


@operator("kmeans_clustering.standard", MODULE, [Slot("x_columns", DISCRETE, BOTH)], {"n_clusters": {"type": "integer", "minimum": 2, "maximum": 1000, "default": 3}, "standardize": {"type": "boolean", "default": True}, "init": {"type": "string", "enum": ["k-means++", "random"], "default": "k-means++"}, "n_init": {"type": "integer", "minimum": 1, "maximum": 100, "default": 10}, "max_iter": {"type": "integer", "minimum": 1, "maximum": 10000, "default": 300}, **_LABEL, "label_column_name": {"type": "string", "minLength": 1, "maxLength": 128, "default": "cluster_kmeans"}}, constraints=(Constraint("min_rows", value=2),), produces_data=True)
def kmeans(run: Run) -> Result:
    """The best of several k-means runs; clusters are numbered by their first row."""
    p = run.params
    df, dropped = complete(run, run.columns("x_columns"))
    made = design(run, df, run.columns("x_columns"), drop_first=False)
    points, centre, scale = scaled_features(df, made, p["standardize"])
    points = settled(points)
    n = points.count()
    if n <= p["n_clusters"]:
        raise data_error("too few rows for the clusters", rows=n)
    vectors = points.withColumn("features", array_to_vector("x")).persist()
    best = None
    for i in range(p["n_init"]):
        model = KMeans(k=p["n_clusters"], initMode="k-means||" if p["init"] == "k-means++" else "random", maxIter=p["max_iter"], tol=1e-4, seed=run.context.random_seed + i).fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost - 1e-12:
            best = model
    raw = best.transform(vectors).select(ROW_ID, "x", F.col("prediction").alias("raw"))
    order = [r["raw"] for r in raw.groupBy("raw").agg(F.min(ROW_ID).alias("first")).orderBy("first").collect()]
    labels = settled(raw.withColumn("label", F.element_at(F.create_map(*(F.lit(v) for i, old in enumerate(order) for v in (old, i))), F.col("raw"))).drop("raw"))
    vectors.unpersist()
    score = silhouette(labels, len(order))
    centres = [{"cluster": i} | {c: float(v) for c, v in zip(made.names, best.clusterCenters()[old] * scale + centre, strict=True)} for i, old in enumerate(order)]
    result = Result([Metric("inertia", best.summary.trainingCost), Metric("silhouette", score), Metric("cluster_count", len(order))], [Table("cluster_centers", centres), Table("cluster_counts", _counts(labels))], [_projection(labels)], metadata={"sample_count": n, "dropped_rows": dropped, "categorical_encoding": made.encoding}, data=_labelled(run, labels))
    _warn(result, dropped, len(made.names))
    return result


#: Dimensions of the grid of neighbour search; further ones only take part in distances.
GRID_DIMENSIONS = 3
#: Point pairs two boxes may have to be compared at once.
TOUCH_PAIRS = 1 << 16
#: Edges of a graph up to which the driver finds its components; beyond, they are found side by side.
DRIVER_EDGES = 300_000


def norm(metric: str, gaps: Column) -> Column:
    if metric == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    if metric == "chebyshev":
        return F.array_max(gaps)
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


def distance(metric: str, a: Column, b: Column) -> Column:
    return norm(metric, F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def nearest(metric: str, low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """No pair of points of two boxes is nearer, as ``distance`` computes it: rounding keeps order."""
    return norm(metric, F.zip_with(F.zip_with(low2, high, lambda x, y: x - y), F.zip_with(low, high2, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))))


def farthest(metric: str, low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """No pair of points of two boxes is farther apart, as ``distance`` computes it."""
    return norm(metric, F.zip_with(F.zip_with(high2, low, lambda x, y: x - y), F.zip_with(high, low2, lambda x, y: x - y), lambda x, y: F.greatest(x, y)))


def _boxes(width: int) -> list[Column]:
    return [F.array(*(f(F.get("x", i)) for i in range(width))).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]


def cells_of(points: DataFrame, eps: float, metric: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Points (row, x, c) and cells (c, n, low, high, place): all points of a cell are within eps, ``c`` is its least row, and cells within eps have places that differ by 1 at most."""
    spread = {"manhattan": width, "chebyshev": 1}.get(metric, width**0.5) * (1 + 1e-6)
    step = int(spread) + 1
    keyed = points.withColumn("cell", F.transform("x", lambda v: F.floor(v / (eps / spread)))).withColumn("key", F.col("cell"))
    boxed = settled(keyed.groupBy("key").agg(F.min(ROW_ID).alias("c"), F.count(F.lit(1)).alias("n"), F.first("cell").alias("cell"), *_boxes(width)))
    if boxed.where(distance(metric, F.col("low"), F.col("high")) > eps).limit(1).count():  # coordinates so large that cells are rounded away
        keyed = keyed.withColumn("key", F.col("x"))
        boxed = settled(keyed.groupBy("key").agg(F.min(ROW_ID).alias("c"), F.count(F.lit(1)).alias("n"), F.first("cell").alias("cell"), *_boxes(width)))
    placed = settled(keyed.join(boxed.select("key", "c"), "key").select(ROW_ID, "x", "c"))
    place = [F.expr(f"(cell[{d}] - pmod(cell[{d}], {step})) div {step}").alias(f"p{d}") for d in range(min(width, GRID_DIMENSIONS))]
    return placed, boxed.select("c", "n", "low", "high", *place)


def cell_pairs(cells: DataFrame, eps: float, metric: str, width: int) -> DataFrame:
    """Cells (a, b) whose boxes come within eps, both ways and itself included, with the count and box of b."""
    places = [f"p{d}" for d in range(min(width, GRID_DIMENSIONS))]
    left = cells.select(F.col("c").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), *places)
    right = cells.withColumnRenamed("c", "b")
    for p in places:
        right = right.withColumn(p, F.explode(F.array(F.col(p) - 1, F.col(p), F.col(p) + 1)))
    return left.join(right, places).where(nearest(metric, F.col("low_a"), F.col("high_a"), F.col("low"), F.col("high")) <= eps).select("a", "b", "n", "low", "high")


def touching(a: np.ndarray, b: np.ndarray, eps: float, metric: str) -> bool:
    """Whether any point of ``a`` is within eps of one of ``b``, by halving the larger box until few pairs are left."""

    def size(gaps: np.ndarray) -> np.ndarray:
        total = np.zeros(gaps.shape[1:])
        for g in gaps:  # in the order of ``distance``
            total = np.maximum(total, g) if metric == "chebyshev" else total + (g if metric == "manhattan" else g * g)
        return total if metric in ("manhattan", "chebyshev") else np.sqrt(total)

    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        low, high, low2, high2 = a.min(0), a.max(0), b.min(0), b.max(0)
        if size(np.maximum(np.maximum(low2 - high, low - high2), 0.0)) > eps:
            continue
        if size(np.maximum(high2 - low, high - low2)) <= eps:
            return True
        if len(a) * len(b) <= TOUCH_PAIRS:
            if (size(np.abs(a.T[:, :, None] - b.T[:, None, :])) <= eps).any():
                return True
            continue
        if len(a) < len(b):
            a, b = b, a
        axis, half = int(np.argmax(np.ptp(a, 0))), len(a) // 2
        split = a[np.argpartition(a[:, axis], half)]
        parts = [split[:half], split[half:]]
        centre = (b[:, axis].min() + b[:, axis].max()) / 2
        parts.sort(key=lambda part: -abs(part[:, axis].mean() - centre))
        waiting += [(part, b) for part in parts]  # the nearer half first
    return False


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the least id of each node's component, by hooking to the least neighbour and jumping."""
    edges = settled(edges)
    if edges.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while (above := up.get(v, v)) != v:
                up[v] = v = up.get(above, above)
            return v

        for i, j in edges.where("i < j").collect():
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        named = edges.sparkSession.createDataFrame([(v, top(v)) for v in list(up)] or [(None, None)], "id long, root long")
        return settled(nodes.select("id").join(named, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    state = settled(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = edges.join(state.toDF("j", "r"), "j").groupBy("i").agg(F.min("r").alias("r")).withColumnRenamed("i", "id")
        hooked = settled(state.join(near, "id", "left").select("id", F.least("root", F.coalesce("r", "root")).alias("root")))
        jumped = hooked.join(hooked.toDF("root", "up"), "root").select("id", F.col("up").alias("root"))
        after = settled(jumped)
        changed = after.join(state.withColumnRenamed("root", "was"), "id").where("root <> was").limit(1).count()
        state = after
        if not changed:
            return state


def core_points(placed: DataFrame, cells: DataFrame, near: DataFrame, eps: float, least: int, metric: str) -> tuple[DataFrame, DataFrame]:
    """Core points (row, x, c), and pairs (row, x, b) of other points with cells in reach. Cells of ``least`` points are core as they are; fewer points than that in any other cell look around."""
    many = cells.where(F.col("n") >= least).select("c")
    sparse = placed.join(many, "c", "left_anti")
    at = F.col("x")
    looks = settled(sparse.join(near, sparse["c"] == near["a"]).where(nearest(metric, at, at, F.col("low"), F.col("high")) <= eps).select(ROW_ID, "x", "b", "n", (farthest(metric, at, at, F.col("low"), F.col("high")) <= eps).alias("whole")))
    sure = looks.where("whole").groupBy(ROW_ID).agg(F.sum("n").alias("sure"))
    open_ = looks.where(~F.col("whole")).join(sure, ROW_ID, "left").where(F.coalesce("sure", F.lit(0)) < least)
    found = open_.join(placed.select(F.col("c").alias("b"), F.col("x").alias("y")), "b").where(distance(metric, F.col("x"), F.col("y")) <= eps).groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("found"))
    core_rows = settled(sure.join(found, ROW_ID, "full").where(F.coalesce("sure", F.lit(0)) + F.coalesce("found", F.lit(0)) >= least).select(ROW_ID))
    core = placed.join(many, "c", "left_semi").unionByName(sparse.join(core_rows, ROW_ID, "left_semi"))
    return settled(core), looks.join(core_rows, ROW_ID, "left_anti").select(ROW_ID, "x", "b")


def cell_roots(core: DataFrame, near: DataFrame, eps: float, metric: str, width: int) -> DataFrame:
    """Cells with core points (c, low, high, root): ``root`` is the least core row of the component. One pair of points within eps joins two cells, so no more are sought than settle it."""
    # Outermost points of a cell: those of neighbours are mostly within eps.
    ends = [f("x", F.get("x", d)) for d in range(min(width, GRID_DIMENSIONS)) for f in (F.min_by, F.max_by)]
    boxed = settled(core.groupBy("c").agg(F.min(ROW_ID).alias("id"), *_boxes(width), F.array_distinct(F.array(*ends)).alias("ends")))
    here, there = (boxed.select(*(F.col(c).alias(f"{c}_{k}") for c in boxed.columns)) for k in "ab")
    pairs = near.where("a < b").select("a", "b").join(here, F.col("a") == F.col("c_a")).join(there, F.col("b") == F.col("c_b"))
    box = [F.col(c) for c in ("low_a", "high_a", "low_b", "high_b")]
    met = F.exists("ends_a", lambda x: F.exists("ends_b", lambda y: distance(metric, x, y) <= eps))
    pairs = settled(pairs.where(nearest(metric, *box) <= eps).select("a", "b", "id_a", "id_b", "low_a", "high_a", "low_b", "high_b", F.when(farthest(metric, *box) <= eps, True).otherwise(met).alias("joined")))

    def both(edges: DataFrame) -> DataFrame:
        return edges.toDF("i", "j").unionByName(edges.toDF("j", "i"))

    roots = connected(both(pairs.where("joined").select("id_a", "id_b")), boxed.select("id"))
    apart = pairs.where(~F.col("joined")).join(roots.toDF("id_a", "root_a"), "id_a").join(roots.toDF("id_b", "root_b"), "id_b").where("root_a <> root_b")
    sides = []
    for own, other in ("ab", "ba"):
        reached = apart.join(core.select(F.col("c").alias(own), "x"), own).where(nearest(metric, F.col("x"), F.col("x"), F.col(f"low_{other}"), F.col(f"high_{other}")) <= eps)
        sides.append(reached.select("a", "b", "root_a", "root_b", F.lit(own).alias("side"), "x").distinct())

    def meet(group):
        import pandas as pd

        first = (group["side"] == "a").to_numpy()
        a, b = (np.array(group["x"][held].tolist(), float).reshape(-1, width) for held in (first, ~first))
        hit = len(a) and len(b) and touching(a, b, eps, metric)
        return pd.DataFrame({"i": group["root_a"].head(int(bool(hit))), "j": group["root_b"].head(int(bool(hit)))})

    more = settled(sides[0].unionByName(sides[1]).groupBy("a", "b").applyInPandas(meet, "i long, j long").distinct())
    if more.limit(1).count():
        upper = connected(both(more), roots.select(F.col("root").alias("id")).distinct())
        roots = roots.join(upper.toDF("root", "top"), "root").select("id", F.col("top").alias("root"))
    return settled(boxed.join(roots, "id").select("c", "low", "high", "root"))


def dbscan_labels(points: DataFrame, eps: float, least: int, metric: str, width: int) -> tuple[DataFrame, int]:
    """(row, label) with -1 for noise, clusters numbered by their least core row; border rows join the lowest adjacent one. Work grows with rows and pairs of cells, not with pairs of rows, where cells hold many rows."""
    placed, cells = cells_of(points, eps, metric, width)
    near = settled(cell_pairs(cells, eps, metric, width))
    core, border = core_points(placed, cells, near, eps, least, metric)
    roots = cell_roots(core, near, eps, metric, width)
    numbers = roots.select("root").distinct()
    ordered = {r["root"]: k for k, r in enumerate(numbers.orderBy("root").limit(1_000_001).collect())}
    if len(ordered) > 1_000_000:
        raise data_error("too many clusters; raise eps", most=1_000_000)
    named = points.sparkSession.createDataFrame(list(ordered.items()) or [(None, None)], "root long, label long")
    labels = settled(roots.join(F.broadcast(named), "root").select("c", "low", "high", "label"))
    core_labels = core.join(labels.select("c", "label"), "c").select(ROW_ID, "label")
    at = F.col("x")
    seen = settled(border.join(labels.withColumnRenamed("c", "b"), "b").where(nearest(metric, at, at, F.col("low"), F.col("high")) <= eps).select(ROW_ID, "x", "b", "label", (farthest(metric, at, at, F.col("low"), F.col("high")) <= eps).alias("whole")))
    open_ = seen.where(~F.col("whole")).join(core.select(F.col("c").alias("b"), F.col("x").alias("y")), "b").where(distance(metric, at, F.col("y")) <= eps)
    touched = seen.where("whole").select(ROW_ID, "label").unionByName(open_.select(ROW_ID, "label")).groupBy(ROW_ID).agg(F.min("label").alias("near"))
    labelled = points.join(core_labels, ROW_ID, "left").join(touched, ROW_ID, "left")
    return labelled.select(ROW_ID, "x", F.coalesce("label", "near", F.lit(-1)).alias("label")), core.count()


@operator("dbscan_clustering.standard", MODULE, [Slot("x_columns", NUMERIC, QUANTITATIVE)], {"eps": {"type": "number", "exclusiveMinimum": 0, "default": 0.5}, "min_samples": {"type": "integer", "minimum": 1, "default": 5}, "metric": {"type": "string", "enum": ["euclidean", "manhattan", "chebyshev"], "default": "euclidean"}, "standardize": {"type": "boolean", "default": True}, **_LABEL, "label_column_name": {"type": "string", "minLength": 1, "maxLength": 128, "default": "cluster_dbscan"}}, constraints=(Constraint("min_rows", value=2),), produces_data=True)
def dbscan(run: Run) -> Result:
    """Density clusters through a grid of cells and connected components."""
    p = run.params
    df, dropped = complete(run, run.columns("x_columns"))
    made = design(run, df, run.columns("x_columns"))
    points, _, _ = scaled_features(df, made, p["standardize"])
    points = settled(points)
    labels, cores = dbscan_labels(points, float(p["eps"]), p["min_samples"], p["metric"], len(made.names))
    labels = settled(labels)
    counts = _counts(labels)
    noise = sum(r["sample_count"] for r in counts if r["cluster"] == -1)
    found = len([r for r in counts if r["cluster"] >= 0])
    result = Result([Metric("cluster_count", found), Metric("noise_count", noise), Metric("core_count", cores)], [Table("cluster_counts", counts)], [_projection(labels)], metadata={"sample_count": sum(r["sample_count"] for r in counts), "dropped_rows": dropped}, data=_labelled(run, labels))
    _warn(result, dropped, len(made.names))
    if not found:
        result.warn("NO_CLUSTERS_FOUND", "no dense region was found")
    return result
