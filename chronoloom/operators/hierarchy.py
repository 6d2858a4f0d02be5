"""Hierarchies of items: aggregation over all levels in one pass, and reconciliation of forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.errors import ColumnNamesError, HierarchyError, OptionError
from chronoloom.scans import settled

TOTAL = "total"
METHODS = ("ols", "wls_struct", "wls_var", "mint_cov", "mint_shrink")
#: Shrinkage is at least this, as a diagonal of zeros has no inverse.
LEAST = 1e-4


def intensity(gram: np.ndarray, fourths: float, nodes: float) -> float:
    """How far correlations shrink: the sum of their variances over the sum of their squares, off the diagonal.

    ``gram`` sums products of standardised errors of two times over the ``nodes``
    whose errors move, ``fourths`` their fourth powers; no pair of nodes is formed.
    """
    t = len(gram)
    squares = (gram**2).sum() / t**2
    noise = (np.diag(gram) ** 2).sum() - t * squares - (fourths - t * nodes)
    if t < 2 or squares - nodes <= 1e-12 * squares:
        return 1.0
    return float(np.clip(t / (t - 1) ** 3 * noise / (squares - nodes), 0, 1))


def _products(local: str):
    """Sums over the nodes of a part of the rows: for each local, the products of each entry of ``a`` with all of ``b``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, rows in pdf.groupby(local, sort=False):
                total = np.vstack(rows["a"]).T @ np.vstack(rows["b"])
                yield pd.DataFrame({local: [key] * len(total), "t": np.arange(len(total)), "row": list(total)})

    return run


class Hierarchy:
    """A table of items with a column for each level, and the parent of each level (or "total").

    Nodes are named by their value, ``|`` and their level; items by their value
    alone; the root is "total".
    """

    def __init__(self, master: DataFrame, parents: Mapping[str, str], item: str, local: str, time: str, target: str):
        self.master, self.parents, self.item, self.local, self.time, self.target = master, dict(parents), item, local, time, target
        self.levels = [level for level in self.parents if level != item]
        missing = [c for c in self.parents if c not in master.columns]
        if missing:
            raise OptionError(f"no levels {missing} in the hierarchy table")

    def code(self, level: str) -> Column:
        if level == TOTAL:
            return F.lit(TOTAL)
        value = F.col(level).cast("string")
        return value if level == self.item else F.concat_ws("|", value, F.lit(level))

    def checked(self) -> None:
        """Each level must have at least as many values as its parent; one aggregation for all levels."""
        n = self.master.agg(*[F.count_distinct(level).alias(level) for level in self.parents]).first()
        for child, parent in self.parents.items():
            if parent != TOTAL and n[child] < n[parent]:
                raise HierarchyError(f"level {child} has fewer values than its parent {parent}")

    def edges(self) -> DataFrame:
        """child, parent of every node; of several parents the least counts."""
        pairs = F.explode(F.array(*[F.struct(self.code(c).alias("child"), self.code(p).alias("parent")) for c, p in self.parents.items()]))
        return self.master.select(pairs.alias("e")).groupBy(F.col("e.child").alias("child")).agg(F.min("e.parent").alias("parent"))

    def aggregated(self, df: DataFrame) -> DataFrame:
        """local, time, target, code: sums of the target on every level.

        Items are summed first, then one pass over grouping sets makes all levels
        from those sums. Rows whose item the hierarchy lacks are left out.
        """
        base = df.groupBy(self.local, self.time, self.item).agg(F.sum(self.target).alias("_y"))
        joined = base.join(self.master.select(*self.parents).dropDuplicates([self.item]), self.item)
        sets = [[self.local, self.time], *[[self.local, self.time, level] for level in self.parents]]
        keys = [self.local, self.time, *self.parents]
        summed = joined.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(F.sum("_y").alias(self.target), *[F.grouping(level).alias(f"_g_{level}") for level in self.parents])
        code = F.lit(TOTAL)
        for level in self.parents:
            code = F.when(F.col(f"_g_{level}") == 0, self.code(level)).otherwise(code)
        return summed.select(self.local, self.time, self.target, code.alias("code"))

    def reconciled_two_levels(self, forecasts: DataFrame) -> DataFrame:
        """Least-squares reconciliation where the root has only items below it, as window sums.

        ``forecasts``: local, time, code, target. With m items, each moves by
        (total - sum of items) / (m + 1), and the total becomes their sum.
        """
        w = Window.partitionBy(self.local, self.time)
        y, root = F.col(self.target), F.col("code") == TOTAL
        items = F.sum(F.when(~root, y)).over(w)
        m = F.sum(F.when(~root, 1).otherwise(0)).over(w)
        shift = (F.max(F.when(root, y)).over(w) - items) / (m + 1)
        return forecasts.withColumn("_s", shift).withColumn("_i", items).withColumn("_m", m).select(self.local, self.time, "code", F.when(root, F.col("_i") + F.col("_m") * F.col("_s")).otherwise(y + F.col("_s")).alias(self.target))

    def named(self, df: DataFrame) -> DataFrame:
        """local, time, code, target of forecasts or sums: ``predictions`` stand for a target, and rows without a code are totals."""
        if self.target not in df.columns and "predictions" in df.columns:
            df = df.withColumnRenamed("predictions", self.target)
        if "code" not in df.columns:
            df = df.withColumn("code", F.lit(TOTAL))
        missing = [c for c in (self.local, self.time, self.target) if c not in df.columns]
        if missing:
            raise ColumnNamesError(f"no columns {missing} among {df.columns}")
        return df.select(self.local, self.time, "code", self.target)

    def reconciliation(self, past: DataFrame, forecasts: DataFrame, method: str = "ols") -> DataFrame:
        """Reconciles ``forecasts`` that follow the sums ``past`` of all levels; see ``named`` for their columns.

        All forecasts must be later than all of the past. The errors that wls_var,
        mint_cov and mint_shrink weigh by are those of yesterday's value as a forecast.
        """
        past, forecasts = self.named(past), self.named(forecasts)
        end = past.agg(F.max(self.time)).first()[0]
        start = forecasts.agg(F.min(self.time)).first()[0]
        if end is not None and start is not None and start <= end:
            raise HierarchyError(f"forecasts start at {start}, but the past ends at {end}")
        errors = None
        if method in ("wls_var", "mint_cov", "mint_shrink"):
            before = F.lag(self.target).over(Window.partitionBy(self.local, "code").orderBy(self.time))
            errors = past.withColumn(self.target, F.col(self.target) - before).where(F.col(self.target).isNotNull())
        return self.decoded(self.reconciled(forecasts, method, errors))

    def reconciled(self, forecasts: DataFrame, method: str = "ols", residuals: DataFrame | None = None, shrinkage: float | None = None) -> DataFrame:
        """Minimum-trace reconciliation of forecasts (local, time, code, target) of each local.

        ``residuals`` (local, time, code, target: in-sample errors) is needed for
        wls_var, mint_cov and mint_shrink, which shrinks the errors' covariance to its
        diagonal, by ``shrinkage`` (0 to 1) or as much as the errors say. Nodes without a forecast at all times are left out.
        With independent errors (the first three methods) and levels in a chain, a
        pass up the tree and one down solve it, by a join a level; mint_shrink adds a
        system as large as the number of past times (see ``_shrunk``). Otherwise a
        local's nodes fit one task, as its matrix does.
        """
        if method not in METHODS:
            raise OptionError(f"method: one of {METHODS}, not {method!r}")
        if method in ("wls_var", "mint_cov", "mint_shrink") and residuals is None:
            raise OptionError(f"{method} needs residuals")
        if shrinkage is not None and not 0 <= shrinkage <= 1:
            raise OptionError("shrinkage: from 0 to 1")
        if method != "mint_cov" and (chain := self.chain()):
            if method == "mint_shrink":
                return self._shrunk(forecasts, chain, residuals, shrinkage)
            return self._by_tree(forecasts, chain, self._weights(forecasts, chain, method, residuals))
        local, time, target = self.local, self.time, self.target
        # every node's items, from the table: (code, item)
        below = self.master.select(F.explode(F.array(F.lit(TOTAL), *[self.code(p) for p in self.parents])).alias("code"), F.col(self.item).cast("string").alias("leaf")).distinct()
        rows = forecasts.select(local, time, "code", F.col(target).cast("double").alias("y"), F.lit(False).alias("past"))
        if residuals is not None:
            rows = rows.unionByName(residuals.select(local, time, "code", F.col(target).cast("double").alias("y"), F.lit(True).alias("past")))
        leaves = below.groupBy("code").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
        joined = rows.join(leaves, "code")

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            now = pdf[~pdf["past"]].pivot_table(index=time, columns="code", values="y").dropna(axis=1)
            codes = list(now.columns)
            held = pdf.drop_duplicates("code").set_index("code")["leaves"]
            items = [c for c in codes if len(held[c]) == 1 and held[c][0] == c]
            place = {c: k for k, c in enumerate(items)}
            s = np.zeros((len(codes), len(items)))
            for r, c in enumerate(codes):
                s[r, [place[x] for x in held[c] if x in place]] = 1.0
            weights = np.eye(len(codes))
            if method == "wls_struct":
                weights = np.diag(np.maximum(s.sum(1), 1.0))
            elif method != "ols":
                e = pdf[pdf["past"]].pivot_table(index=time, columns="code", values="y").reindex(columns=codes).dropna().to_numpy()
                if method == "wls_var":
                    weights = np.diag(np.maximum((e**2).mean(0), 1e-12))
                else:
                    weights = np.cov(e.T, bias=True) + 1e-9 * np.eye(len(codes))
                if method == "mint_shrink":
                    x = e - e.mean(0)
                    z = x / np.sqrt(np.maximum((x**2).mean(0), 1e-12))
                    share = max(intensity(z @ z.T, (z**4).sum(), (z.any(0)).sum()) if shrinkage is None else shrinkage, LEAST)
                    weights = (1 - share) * (weights - 1e-9 * np.eye(len(codes))) + share * np.diag(np.maximum((x**2).mean(0), 1e-12))
            inverse = np.linalg.pinv(weights)
            fit = s @ np.linalg.pinv(s.T @ inverse @ s) @ s.T @ inverse
            made = now.to_numpy() @ fit.T
            out = pd.DataFrame({time: np.repeat(now.index.to_numpy(), len(codes)), "code": np.tile(codes, len(now)), target: made.ravel()})
            out[local] = pdf[local].iloc[0]
            return out[[local, time, "code", target]]

        kinds = {f.name: f.dataType.simpleString() for f in forecasts.schema.fields}
        return joined.groupBy(local).applyInPandas(solve, f"`{local}` {kinds[local]}, `{time}` {kinds[time]}, code string, `{target}` double")

    def chain(self) -> list[str] | None:
        """The levels from the items up, if each has one below it; else none."""
        out = [self.item]
        while (up := self.parents[out[-1]]) != TOTAL:
            out.append(up)
        return out if len(out) == len(self.parents) else None

    def _known(self, forecasts: DataFrame) -> DataFrame:
        """local, code of the nodes with a forecast at all times of their local."""
        local, time = self.local, self.time
        rows = forecasts.select(local, time, "code", F.col(self.target).alias("y")).where("y is not null")
        times = rows.groupBy(local).agg(F.count_distinct(time).alias("_all"))
        return rows.groupBy(local, "code").agg(F.count_distinct(time).alias("_some")).join(times, local).where("_some = _all").select(local, "code")

    def _weights(self, forecasts: DataFrame, chain: list[str], method: str, residuals: DataFrame | None) -> DataFrame:
        """local, code, w: the error variance that each method takes a node's forecast to have."""
        local, known = self.local, self._known(forecasts)
        if method == "ols":
            return known.withColumn("w", F.lit(1.0))
        if method == "wls_struct":  # as many as the node has items with forecasts
            parents = self._paths(chain)
            below = known.join(parents, F.col("code") == F.col("c0")).select(local, F.explode(F.array(*parents.columns)).alias("code"))
            return known.join(below.groupBy(local, "code").agg(F.count(F.lit(1)).cast("double").alias("w")), [local, "code"])
        errors = residuals.groupBy(local, "code").agg(F.greatest(F.avg(F.pow(F.col(self.target).cast("double"), F.lit(2))), F.lit(1e-12)).alias("w"))
        return known.join(errors, [local, "code"])

    def _paths(self, chain: list[str]) -> DataFrame:
        """c0, c1, ..: the codes from each item up to the total."""
        return self.master.select(*[self.code(c).alias(f"c{i}") for i, c in enumerate(chain)], F.lit(TOTAL).alias(f"c{len(chain)}")).distinct()

    def _shrunk(self, forecasts: DataFrame, chain: list[str], residuals: DataFrame, shrinkage: float | None) -> DataFrame:
        """Minimum trace with errors of covariance s * V + (1 - s) / T * X X': V the diagonal, X the nodes' centred errors at T times.

        Forecasts are then sums that add up, plus X z with independent standard z,
        plus independent errors. For given z the tree solves the rest (``_by_tree``),
        also for the columns of X; so z comes from a system of T equations a local,
        whose entries are sums over the nodes. No matrix of nodes is ever made.
        """
        local, time, target = self.local, self.time, self.target
        at, node = [local, time], [local, "code"]
        # every table is read several times, so each is made once and plans stay short
        tree = Hierarchy(settled(self.master.select(*self.parents).distinct()), self.parents, self.item, local, time, target)
        forecasts = settled(forecasts.select(*at, "code", target))
        known = settled(self._known(forecasts))
        errors = residuals.where(F.col(target).isNotNull()).join(known, node).groupBy(*at, "code").agg(F.avg(F.col(target).cast("double")).alias("y"))
        errors = settled(errors)
        whole = errors.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).join(known.groupBy(local).agg(F.count(F.lit(1)).alias("_all")), local).where("_n = _all")
        whole = whole.select(*at, F.row_number().over(Window.partitionBy(local).orderBy(time)).alias("t"))
        held = errors.join(whole, at).groupBy(*node).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("e"), F.avg("y").alias("m"))
        held = held.select(*node, F.transform("e", lambda v: v - F.col("m")).alias("x"))
        held = settled(held.withColumn("w", F.greatest(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x"), F.lit(1e-12))))
        weights = settled(held.select(*node, "w"))

        def spread(df: DataFrame, order: str, values: str) -> DataFrame:
            return df.groupBy(*node).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v")))).alias("_l"))

        past = held.select(local, F.posexplode("x").alias(time, target), "code").select(local, time, "code", target)
        past = spread(settled(tree._by_tree(past, chain, weights)), time, target).select(*node, F.transform("_l", lambda s: s["v"]).alias("px"))
        now = forecasts.join(weights, node).select(*at, "code", F.col(target).cast("double").alias("y"))
        now = now.join(settled(tree._by_tree(forecasts, chain, weights)).withColumnRenamed(target, "p"), [*at, "code"])
        now = spread(now.select(*node, time, F.struct("y", "p").alias("v")), time, "v")
        nodes = settled(held.join(past, node).join(now, node))
        left = F.transform("x", lambda v: v / F.col("w"))
        right = F.concat("x", F.zip_with("x", "px", lambda a, b: a - b), F.transform("_l", lambda s: s["v"]["y"] - s["v"]["p"]))
        kind = forecasts.schema[local].dataType.simpleString()
        parts = nodes.select(local, left.alias("a"), right.alias("b")).mapInPandas(_products(local), f"`{local}` {kind}, t int, row array<double>")
        cells = parts.select(local, "t", F.posexplode("row").alias("u", "v")).groupBy(local, "t", "u").agg(F.sum("v").alias("v"))
        system = cells.groupBy(local).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "u", "v"))), lambda s: s["v"]).alias("_f"), (F.max("t") + 1).alias("_t"))
        fourth = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(4))) / (F.col("w") * F.col("w"))
        moving = F.when(F.exists("x", lambda v: v != 0), 1.0).otherwise(0.0)
        system = system.join(nodes.groupBy(local).agg(F.sum(fourth).alias("_q"), F.sum(moving).alias("_m")), local)

        @F.pandas_udf("array<array<double>>")
        def solved(flat: pd.Series, times: pd.Series, fourths: pd.Series, moving: pd.Series) -> pd.Series:
            out = []
            for f, t, q, m in zip(flat, times, fourths, moving, strict=True):
                own, rest, asked = np.split(np.asarray(f).reshape(t, -1), [t, 2 * t], axis=1)
                share = max(intensity(own, q, m) if shrinkage is None else shrinkage, LEAST)
                c = (1 - share) / (share * t)
                out.append((np.linalg.solve(np.eye(t) + c * rest, c * asked)).T.tolist())
            return pd.Series(out)

        factors = system.select(local, solved("_f", "_t", "_q", "_m").alias("_z"))
        each = nodes.join(factors, local).select(local, "code", "px", "_z", F.posexplode("_l").alias("_h", "s"))
        moved = F.aggregate(F.zip_with("px", F.get("_z", F.col("_h")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return each.select(local, F.col("s.o").alias(time), "code", (F.col("s.v.p") - moved).alias(target))

    def _by_tree(self, forecasts: DataFrame, chain: list[str], weights: DataFrame) -> DataFrame:
        """Least squares with independent errors of variances ``weights``: going up, each node's forecast is weighed against the sum of its children; going down, what is left is shared by variance."""
        local, time, target = self.local, self.time, self.target
        rows = forecasts.select(local, time, "code", F.col(target).cast("double").alias("y")).where("y is not null")
        parents = self._paths(chain)
        own = rows.join(weights, [local, "code"])
        at = [local, time]
        nodes = [parents.select(F.col(f"c{i}").alias("code"), F.col(f"c{i + 1}").alias("parent") if i < len(chain) else F.lit(None).cast("string").alias("parent")).groupBy("code").agg(F.min("parent").alias("parent")) for i in range(len(chain) + 1)]
        up = [own.join(nodes[0], "code").select(*at, "code", "parent", F.col("y").alias("e"), F.col("w").alias("v"), F.lit(0.0).alias("sum_e"), F.lit(0.0).alias("sum_v"), F.lit(True).alias("own"))]
        for i in range(1, len(chain) + 1):
            sums = up[-1].groupBy(*at, F.col("parent").alias("code")).agg(F.sum("e").alias("sum_e"), F.sum("v").alias("sum_v")).join(nodes[i], "code")
            both = sums.join(own, [*at, "code"], "left")
            e = F.when(F.col("y").isNull(), F.col("sum_e")).otherwise((F.col("sum_e") * F.col("w") + F.col("y") * F.col("sum_v")) / (F.col("sum_v") + F.col("w")))
            v = F.when(F.col("y").isNull(), F.col("sum_v")).otherwise(F.col("sum_v") * F.col("w") / (F.col("sum_v") + F.col("w")))
            up.append(both.select(*at, "code", "parent", e.alias("e"), v.alias("v"), "sum_e", "sum_v", F.col("y").isNotNull().alias("own")))
        above = up[-1].withColumn("x", F.col("e"))
        out = above
        for level in reversed(up[:-1]):
            given = above.select(*at, F.col("code").alias("parent"), F.col("x").alias("_x"), F.col("sum_e").alias("_e"), F.col("sum_v").alias("_v"))
            above = level.join(given, [*at, "parent"]).select(*level.columns, (F.col("e") + F.col("v") / F.col("_v") * (F.col("_x") - F.col("_e"))).alias("x"))
            out = out.unionByName(above)
        return out.where("own").select(local, time, "code", F.col("x").alias(target))

    def decoded(self, df: DataFrame) -> DataFrame:
        """Adds code_type (the level, "total" or the item column) and the bare value of each code."""
        parts = F.split("code", "[|]")
        return df.withColumn("code_type", F.when(F.col("code") == TOTAL, TOTAL).when(F.size(parts) > 1, parts[1]).otherwise(self.item)).withColumn("code", F.when(F.size(parts) > 1, parts[0]).otherwise(F.col("code")))
