"""Near-duplicate vectors: spherical k-means cells, blocked cosine products.

Vectors are scaled to length 1; equal ones are one class, counted and not compared. Spherical k-means
(fitted on at most FIT vectors, chosen by a hash) gives every vector the cell of its best centre. A pair
with cosine >= t is at most r = sqrt(2 - 2t) apart, so it lies in one cell, or the distances of its two ends
to the plane between their cells add up to r at most, and one of them is r / 2 or less. A vector visits every
other cell whose plane is within r / 2 of it: no pair is lost. If both ends visit, the pair counts where the
one nearer to the plane visits (of equally near ones that of the lower id). A cell with more than SPLIT members
is cut again in the same way, by centres fitted on its own members: its members and visitors get cells within it,
visit those nearby, and a pair counts where both levels say so. Cells are dealt in blocks of a
bounded size; a block of members is held against a block of members or visitors in float32 products of SLICE
rows, and what is near t is decided in double precision.

A tile returns the number of links of each vector it holds and, for the components, one link from each
vector to the first of its group of linked vectors, not all pairs.

Vectors that are null, zero, or hold a null or non-finite component link with nothing. Each row is a vector of
its own, whatever its id: rows are numbered once, and ids come in at the end. So repeated ids give a row each, with
that row's links; component_id is the least id in a row's group, null if all of them are null, and kept says that
the two are the same, null or not. Vectors of another length than the commonest link only among their own length.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, components, read, split_join
from .texts import batch_of

#: Vectors that k-means is fitted on, about; a cell's expected size; cells of one level at most, and the members
#: from which a cell is cut again; a tile's side, and numbers in one side at most (longer vectors get smaller tiles);
#: rows of a product.
FIT, CELL, LEVEL, SPLIT, SIDE, NUMBERS, SLICE = 20_000, 4096, 4096, 16_384, 8192, 1 << 20, 256


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, v array<double>) of the vectors that can link."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select("row", "vec_id", v.alias("v")).where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # else squares of very large ones overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of length 1."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        best = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, best, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres)
    return centres


def placed(y: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own cell): each row in its own cell and in each cell it visits, whose plane is within the radius."""
    score = y @ centres.T
    own = score.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[own]
    near = score[np.arange(len(y)), own][:, None] - score <= radius * gap + 1e-9
    near[np.arange(len(y)), own] = True
    row, cell = np.nonzero(near)
    return row, cell, own[row]


def assign(df: DataFrame, centres: np.ndarray, radius: float) -> DataFrame:
    """(cell, vec_id, copies, own, home, v)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array(batch.column(1).to_pylist(), float))
            for i in range(0, len(x), 4096):
                y = x[i : i + 4096]
                row, cell, own = placed(y, centres, radius)
                flat = pa.array(y[row].ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) + 1, dtype=np.int32) * y.shape[1]), flat)
                yield batch_of(cell=pa.array(cell.astype(np.int32)), vec_id=batch.column(0).slice(i, len(y)).take(pa.array(row)), copies=batch.column(2).slice(i, len(y)).take(pa.array(row)), own=pa.array(own.astype(np.int32)), home=pa.array(own == cell), v=vec)

    return df.select("vec_id", "v", "copies").mapInArrow(run, "cell int, vec_id long, copies long, own int, home boolean, v array<double>")


def cut(ws: Workspace, rows: DataFrame, radius: float, tag: str) -> DataFrame:
    """assign's rows with sub (the cell within the cell), own2, inside (whether the row is one of the tile's members)
    and diff, its own centre less that of the cell it visits. Cells that aren't cut have sub 0 and no diff."""
    plain = rows.select("*", F.lit(0).alias("sub"), F.lit(0).alias("own2"), F.col("home").alias("inside"), F.lit(None).cast("array<double>").alias("diff"))
    sizes = ws.table(rows.groupBy("cell").agg(F.count_if("home").alias("members"), F.count("*").alias("all")).where(F.col("members") > SPLIT), f"large-{tag}")
    large = sizes.count()
    if not large:
        return plain
    big = rows.join(F.broadcast(sizes), "cell")  # at most LEVEL cells
    share = F.lit(float(FIT)) / F.col("members") * (1 << 20)
    sample = big.where(F.col("home") & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) <= share)).select("cell", "members", "v")

    size, level = CELL, LEVEL

    def centres_of(pdf):
        import pandas as pd

        x = np.stack(pdf["v"].to_numpy())
        c = fit(x, max(2, min(level, round(pdf["members"].iat[0] / size))))
        return pd.DataFrame({"cell": pdf["cell"].iat[0], "at": np.arange(len(c)), "c": list(c)})

    centres = ws.table(sample.groupBy("cell").applyInPandas(centres_of, "cell int, at int, c array<double>"), f"centres-{tag}")
    part = F.ceil(F.col("all") / F.lit(SIDE)).cast("int")
    spread = centres.join(F.broadcast(sizes), "cell").select("cell", "at", "c", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"))

    def place(left, right):
        import pandas as pd

        c = np.stack(right.sort_values("at")["c"].to_numpy())
        y = np.stack(left["v"].to_numpy())
        row, sub, own = placed(y, c, radius)
        out = left.drop(columns="part").iloc[row].reset_index(drop=True)
        home = own == sub
        return out.assign(sub=sub.astype(np.int32), own2=own.astype(np.int32), inside=home, diff=pd.Series([None if h else c[o] - c[k] for h, o, k in zip(home, own, sub, strict=True)], dtype=object))

    dealt_ = big.withColumn("part", F.pmod(F.xxhash64("vec_id"), part).cast("int")).select("cell", "vec_id", "copies", "own", "home", "v", "part")
    small = plain.join(F.broadcast(sizes.select("cell")), "cell", "left_anti")
    schema = "cell int, vec_id long, copies long, own int, home boolean, v array<double>, sub int, own2 int, inside boolean, diff array<double>"
    split = dealt_.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(place, schema)
    return ws.table(small.unionByName(split), f"cut-{tag}")


ROW = ("vec_id", "copies", "own", "home", "own2", "diff", "v")


def dealt(rows: DataFrame, side: int) -> DataFrame:
    """Rows with their tiles (x, y). Members of a cell form blocks, visitors too; a block of members
    meets itself, the blocks of members before it, and every block of visitors."""
    size = rows.groupBy("cell", "sub").agg(F.ceil(F.count_if("inside") / F.lit(side)).cast("int").alias("members"), F.ceil(F.count_if(~F.col("inside")) / F.lit(side)).cast("int").alias("visitors"))
    placed_ = rows.join(size.where("members > 0"), ["cell", "sub"])
    k = F.pmod(F.xxhash64("vec_id"), F.when(F.col("inside"), F.col("members")).otherwise(F.col("visitors"))).cast("int")
    placed_ = placed_.withColumn("k", k)
    all_members = F.sequence(F.lit(0), F.col("members") - 1)
    guests = F.when(F.col("visitors") > 0, F.transform(F.sequence(F.lit(1), F.greatest("visitors", F.lit(1))), lambda i: F.struct(F.col("k").alias("x"), (-i).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    among = F.transform(all_members, lambda i: F.struct(F.greatest(i, F.col("k")).alias("x"), F.least(i, F.col("k")).alias("y")))
    visits = F.transform(all_members, lambda i: F.struct(i.alias("x"), (-F.col("k") - 1).alias("y")))
    tile = F.explode(F.when(F.col("inside"), F.concat(among, guests)).otherwise(visits)).alias("t")
    return placed_.select("cell", "sub", *ROW, F.when(F.col("inside"), F.col("k")).otherwise(-F.col("k") - 1).alias("side"), tile).select("cell", "sub", *ROW, "side", "t.x", "t.y")


def tile_links(x: np.ndarray, y: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with cosine >= t, in double precision where float32 can't tell; SLICE rows of x at once."""
    y32 = y.astype(np.float32)
    for a in range(0, len(x), SLICE):
        c = x[a : a + SLICE].astype(np.float32) @ y32.T
        i, j = np.nonzero(c >= t - 1e-5)
        close = np.flatnonzero(c[i, j] < t + 1e-5)
        wrong = [close[k : k + 65536] for k in range(0, len(close), 65536)]
        wrong = [w[np.einsum("ij,ij->i", x[a + i[w]], y[j[w]]) < t] for w in wrong]
        i, j = (np.delete(z, np.concatenate(wrong)) if wrong else z for z in (i, j))
        yield a + i, j


def nearer(x: np.ndarray, y: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, own: np.ndarray, diffs: dict[int, np.ndarray]) -> Callable:
    """For visitors y (from the cells own) of members x of a cell: (i, j) -> which pairs count here. diffs: a
    visitor's own centre less the cell's. Distances are sums of the same products on both sides of a plane, so exactly
    one side has a pair."""
    of_y = np.zeros(len(y))
    for c in diffs:
        of_y[own == c] = (y[own == c] * diffs[c]).sum(1)
    of_x: dict[int, np.ndarray] = {}

    def counts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for c in np.unique(own[j]).tolist():
            if c not in of_x:
                of_x[c] = (x * -diffs[c]).sum(1)
            k = np.flatnonzero(own[j] == c)
            mine, theirs = of_y[j[k]], of_x[c][i[k]]
            out[k] = (mine < theirs) | ((mine == theirs) & (ids_y[j[k]] < ids_x[i[k]]))
        return out

    return counts


def allowed(x: dict, y: dict, cell: int, centres: np.ndarray) -> Callable:
    """(i, j) -> which pairs count in a cell of the first level: two members, or a member and a visitor that is
    nearer to the plane; never two visitors. x, y: the columns of both sides."""
    if x["home"].all() and y["home"].all():
        return lambda i, j: np.ones(len(i), bool)
    diffs = {c: centres[c] - centres[cell] for c in np.unique(np.concatenate([x["own"], y["own"]])).tolist()}
    of_y, of_x = (nearer(a["v"], b["v"], a["vec_id"], b["vec_id"], b["own"], diffs) for a, b in ((x, y), (y, x)))

    def counts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = x["home"][i], y["home"][j]
        out = a & b
        k = np.flatnonzero(a & ~b)
        out[k] = of_y(i[k], j[k])
        k = np.flatnonzero(~a & b)
        out[k] = of_x(j[k], i[k])
        return out

    return counts


def merged(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least place of each place's component, after the links (i, j) are added to those that low stands for."""
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def near_vectors(ws: Workspace, df: DataFrame, t: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    every = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    every = ws.table(every, "rows")
    good = ws.table(usable(every), "usable")
    # inside, a class goes by its least row
    classes = ws.table(good.groupBy("v").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("copies")), "classes")
    results = []
    for size, n in sorted((r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        same = classes.where(F.size("v") == size).select(F.col("id").alias("vec_id"), "copies", "v")
        share = min(1.0, FIT / n)
        sample = same.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * FIT).toPandas()["v"]
        rows = unit(np.stack(sample.to_numpy()).astype(float)) if len(sample) else None
        cells = max(1, min(LEVEL, round(n / CELL)))
        centres = fit(rows, cells) if rows is not None else np.eye(1, size)
        radius = (2 - 2 * t) ** 0.5 / 2
        rows = cut(ws, ws.table(assign(same, centres, radius), f"cells-{size}"), radius, str(size))
        results.append(_within(dealt(rows, max(1, min(SIDE, NUMBERS // size))), t, centres))
    if not results:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    found = ws.table(found, "found")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    comp = ws.table(components(ws, found.where("b IS NOT NULL").select("a", "b"), "groups"), "components").withColumnRenamed("id", "cid")
    of_class = classes.join(links, F.col("id") == F.col("a"), "left").join(comp, F.col("id") == F.col("cid"), "left")
    of_class = ws.table(of_class.select("v", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("group")), "of-class")
    groups = ws.table(of_class.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    named = ws.table(split_join(of_class, groups, ["group"], "inner", "m").select("v", "copies", "n_links", "component_id"), "named")
    per = split_join(good, named, ["v"], "inner", "copies").select("row", "n_links", "component_id", F.lit(True).alias("found"))
    out = every.select("row", "vec_id").join(per, "row", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _within(tiles: DataFrame, t: float, centres: np.ndarray) -> DataFrame:
    """(a, b, n): links of a with their number (b null), and spanning links (n null)."""

    def tile(pdf):
        import pandas as pd

        k, m = pdf["x"].iat[0], pdf["y"].iat[0]
        sides = {}
        for side in (k, m):
            part = pdf[pdf["side"] == side]
            if part.empty:
                return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="Int64")})
            if side not in sides:
                sides[side] = {c: part[c].to_numpy() for c in ROW if c != "v"} | {"v": np.stack(part["v"].to_numpy())}
        left, right = sides[k], sides[m]
        x, y, a, b = left["v"], right["v"], left["vec_id"], right["vec_id"]
        rules = [allowed(left, right, pdf["cell"].iat[0], centres)]
        if k == m:
            rules.append(lambda i, j: i < j)
        elif m < 0 and right["diff"][0] is not None:
            cells, at = np.unique(right["own2"], return_index=True)
            rules.append(nearer(x, y, a, b, right["own2"], {int(c): np.asarray(right["diff"][p]) for c, p in zip(cells, at, strict=True)}))
        of_x, of_y = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        who = a if k == m else np.concatenate([a, b])
        low = np.arange(len(who))
        for i, j in tile_links(x, y, t):
            for rule in rules:
                keep = rule(i, j)
                i, j = i[keep], j[keep]
            np.add.at(of_x, i, right["copies"][j])
            np.add.at(of_y, j, left["copies"][i])
            low = merged(low, i, j + len(who) - len(b))
        n = of_x + of_y if k == m else np.concatenate([of_x, of_y])
        far = np.flatnonzero(low != np.arange(len(who)))
        star = pd.DataFrame({"a": who[far], "b": pd.array(who[low[far]], "Int64"), "n": pd.array([None] * len(far), "Int64")})
        count = pd.DataFrame({"a": who[n > 0], "b": pd.array([None] * int((n > 0).sum()), "Int64"), "n": pd.array(n[n > 0], "Int64")})
        return pd.concat([count, star])

    return tiles.groupBy("cell", "sub", "x", "y").applyInPandas(tile, "a long, b long, n long")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(Workspace(spark, "vectors"), read(spark, sf_dir, "embeddings"), 0.9)


QUERIES = {"op3_embeddings": op3_embeddings}
