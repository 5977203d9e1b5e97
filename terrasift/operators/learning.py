"""Grouped validation, tree ensembles and the constrained weight fit.

Cleaned labels are few (one row per market or listing); they are what the driver
or one task holds. Nothing here collects cells: models are applied to them in
batches.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPONENTS

ARTIFACT_VERSION = 5
WEIGHT_VERSION = 1
#: The most training rows that a fit takes to one place.
MOST_ROWS = 200_000
#: The most groups of which the fold table is made on the driver.
MOST_GROUPS = 100_000

MARKET_FEATURES = ("log_city_population", "log_bank_deposits_php", "log_bank_accounts", "log_bank_offices", "log_bank_deposits_per_capita_php", "log_local_tax_revenue_php", "log_local_tax_revenue_per_capita_php", "log_real_property_tax_php", "log_business_tax_php")
CELL_FEATURES = ("dist_cbd_km", "dist_major_road_km", "log_establishment_access", "log_poi_weighted_density", "log_road_density_km", "log_poi_count", "builtup_score", "in_metro", *(f for f in MARKET_FEATURES if f not in ("log_bank_accounts", "log_bank_offices")))


def fold_table(sizes: dict[str, int], folds: int) -> dict[str, int]:
    """Groups to folds: the largest group first (ties by name), each to the lightest fold."""
    load = [0] * folds
    out = {}
    for group in sorted(sizes, key=lambda g: (-sizes[g], g)):
        fold = min(range(folds), key=lambda f: (load[f], f))
        out[group] = fold
        load[fold] += sizes[group]
    return out


def with_folds(df: DataFrame, group: str, most: int = 5) -> DataFrame:
    """df with fold: all rows of a group in one fold."""
    counted = df.groupBy(F.coalesce(group, F.lit("unknown")).alias("g")).count()
    rows = counted.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    table = fold_table({r["g"]: r["count"] for r in rows}, min(most, max(1, len(rows))))
    small = df.sparkSession.createDataFrame(list(table.items()) or [("", 0)], "g string, fold int")
    return df.withColumn("g", F.coalesce(group, F.lit("unknown"))).join(F.broadcast(small), "g").drop("g")


class ExtraTrees:
    """A mean of trees whose splits draw random thresholds and keep the best of them.
    Missing values take the column's median; a column without any counts as 0."""

    def __init__(self, n_trees: int = 400, min_leaf: int = 2, max_features: float = 1.0, seed: int = 42):
        self.n_trees, self.min_leaf, self.max_features, self.seed = n_trees, min_leaf, max_features, seed

    def _filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), x, self.middle)

    def fit(self, x: np.ndarray, y: np.ndarray) -> ExtraTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        known = np.where(np.isfinite(x), x, np.nan)
        self.middle = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in known.T])
        x = self._filled(x)
        rng = np.random.default_rng(self.seed)
        self.trees = [self._grow(x, y, np.arange(len(y)), rng) for _ in range(self.n_trees)]
        return self

    def _grow(self, x, y, rows, rng):
        own = y[rows]
        if len(rows) < 2 * self.min_leaf or np.ptp(own) == 0:
            return own.mean()
        cols = rng.permutation(x.shape[1])
        best, tried = None, 0
        for c in cols:
            v = x[rows, c]
            lo, hi = v.min(), v.max()
            if lo == hi:
                continue
            at = rng.uniform(lo, hi)
            left = v <= at
            n = int(left.sum())
            tried += 1
            if min(n, len(rows) - n) >= self.min_leaf:
                gain = own[left].sum() ** 2 / n + own[~left].sum() ** 2 / (len(rows) - n)
                if best is None or gain > best[0]:
                    best = gain, c, at, left
            if tried >= max(1, int(self.max_features * x.shape[1])) and best is not None:
                break
        if best is None:
            return own.mean()
        _, c, at, left = best
        return c, at, self._grow(x, y, rows[left], rng), self._grow(x, y, rows[~left], rng)

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = self._filled(np.asarray(x, float))
        out = np.zeros(len(x))
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if not isinstance(node, tuple):
                    out[rows] += node
                    continue
                c, at, low, high = node
                left = x[rows, c] <= at
                stack += [(low, rows[left]), (high, rows[~left])]
        return out / self.n_trees


class Boosted:
    """Gradient boosting of small trees on absolute error: trees follow the sign of the
    residual, leaves take its median. Missing values go with the smaller side."""

    def __init__(self, n_trees: int = 300, rate: float = 0.05, leaves: int = 5, min_leaf: int = 2):
        self.n_trees, self.rate, self.leaves, self.min_leaf = n_trees, rate, leaves, min_leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.where(np.isfinite(x), x, -np.inf), np.asarray(y, float)
        self.base = float(np.median(y))
        self.trees, now = [], np.full(len(y), self.base)
        for _ in range(self.n_trees):
            rest = y - now
            parts = [np.arange(len(y))]
            splits = []
            while len(parts) < self.leaves:
                found = [(s, i) for i, rows in enumerate(parts) if (s := self._split(x, np.sign(rest), rows))]
                if not found:
                    break
                (_, c, at), i = max(found, key=lambda f: (f[0][0], -f[1]))
                rows = parts.pop(i)
                splits.append((i, c, at))
                parts += [rows[x[rows, c] <= at], rows[x[rows, c] > at]]
            values = [float(np.median(rest[rows])) * self.rate for rows in parts]
            for rows, v in zip(parts, values, strict=True):
                now[rows] += v
            self.trees.append((splits, values))
        return self

    def _split(self, x, slope, rows):
        best = None
        if len(rows) < 2 * self.min_leaf:
            return None
        total = slope[rows].sum() ** 2 / len(rows)
        for c in range(x.shape[1]):
            order = rows[np.argsort(x[rows, c], kind="stable")]
            v, s = x[order, c], np.cumsum(slope[order])
            n = np.arange(1, len(order))
            gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(order) - n) - total
            gain[(v[1:] == v[:-1]) | (n < self.min_leaf) | (len(order) - n < self.min_leaf)] = -1
            i = int(np.argmax(gain))
            if gain[i] > 1e-12 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), c, float(v[i])
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isfinite(x), x, -np.inf)
        out = np.full(len(x), self.base)
        for splits, values in self.trees:
            parts = [np.arange(len(x))]
            for i, c, at in splits:
                rows = parts.pop(i)
                parts += [rows[x[rows, c] <= at], rows[x[rows, c] > at]]
            for rows, v in zip(parts, values, strict=True):
                out[rows] += v
        return out


MAKERS = {
    "market": lambda p: ExtraTrees(p.get("n_trees", 400), p["min_leaf"], p["max_features"]),
    "cell": lambda p: Boosted(p.get("n_trees", 300), p.get("rate", 0.05), p["leaves"], p["min_leaf"]),
}
GRIDS = {
    "market": {"min_leaf": [2, 3], "max_features": [0.7, 1.0]},
    "cell": {"leaves": [3, 5, 7], "min_leaf": [2, 3]},
}


def candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


@dataclass
class Fitted:
    """A model of log prices and what its validation found."""

    model: object
    metadata: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """df with exp of the model's prediction, in Arrow batches."""
        features, sent = self.metadata["feature_names"], df.sparkSession.sparkContext.broadcast(self.model)

        def run(batches):
            for part in batches:
                x = part[features].astype(float).to_numpy() if len(part) else np.zeros((0, len(features)))
                yield part.assign(**{out: np.exp(sent.value.predict(x))})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{schema}, `{out}` double")


def validate(training: DataFrame, kind: str, features: tuple[str, ...], group: str, price: str, grid: dict[str, list], inner: int = 4, outer: int = 5) -> tuple[pd.DataFrame, list[dict], list[dict]]:
    """(out-of-fold log predictions, the grid's scores, each outer fold's choice).

    Every fit is one group of a grouped map over (outer fold, parameters, inner
    fold), so all of them run in parallel; the training rows are copied to each."""
    spark = training.sparkSession
    df = training.select(F.monotonically_increasing_id().alias("row"), F.coalesce(group, F.lit("unknown")).alias("g"), F.log(F.col(price).cast("double")).alias("y"), *(F.col(c).cast("double").alias(c) for c in features))
    rows = df.limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} training rows")
    rows = rows.sort_values(["g", "y", *features], ignore_index=True).assign(row=range(len(rows)))
    sizes = rows["g"].value_counts().to_dict()
    outer_of = fold_table(sizes, min(outer, len(sizes)))
    all_params = candidates(grid)
    jobs = []
    for f in sorted(set(outer_of.values())):
        left = {g: n for g, n in sizes.items() if outer_of[g] != f}
        inner_of = fold_table(left, min(inner, len(left)))
        for p in range(len(all_params)):
            jobs += [(f, p, k, json.dumps([g for g in left if inner_of[g] != k]), json.dumps([g for g in left if inner_of[g] == k])) for k in sorted(set(inner_of.values()))]
            jobs.append((-1, p, f, json.dumps(sorted(left)), json.dumps([g for g in sizes if outer_of[g] == f])))
    sent = spark.sparkContext.broadcast((rows, all_params))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        data, params = sent.value
        out = []
        for j in part.itertuples():
            train, test = data[data["g"].isin(json.loads(j.train))], data[data["g"].isin(json.loads(j.test))]
            model = MAKERS[kind](params[j.params]).fit(train[list(features)].to_numpy(), train["y"].to_numpy())
            out.append(pd.DataFrame({"outer": j.outer, "params": j.params, "row": test["row"].to_numpy(), "y": test["y"].to_numpy(), "predicted": model.predict(test[list(features)].to_numpy())}))
        return pd.concat(out)

    table = spark.createDataFrame(jobs, "outer int, params int, inner int, train string, test string")
    made = table.groupBy("outer", "params", "inner").applyInPandas(run, "outer int, params int, row long, y double, predicted double")
    made = made.toPandas()
    made["off"] = (made["y"] - made["predicted"]).abs()
    score = made.groupby(["outer", "params"])["off"].median()
    best = {f: min(range(len(all_params)), key=lambda p, f=f: (score[f, p], p)) for f in sorted({j[0] for j in jobs})}
    choice = {f: best[f] for f in set(outer_of.values())}
    held = made[made["outer"] == -1].merge(rows[["row", "g"]], on="row")
    held = held[held["params"] == held["g"].map(outer_of).map(choice)].sort_values("row")
    results = [{**p, "median_absolute_log_error": float(score[-1, i])} for i, p in enumerate(all_params)]
    return held, results, [all_params[choice[f]] for f in sorted(choice)]


def fit(training: DataFrame, kind: str, features: tuple[str, ...], group: str, price: str = "price_per_sqm_php", minimum_rows: int = 8, minimum_groups: int = 3, grid: dict[str, list] | None = None) -> Fitted:
    """Nested validation with whole groups held out, then the chosen model on all rows."""
    n, groups = training.count(), training.select(F.coalesce(group, F.lit("unknown"))).distinct().count()
    if n < max(8, minimum_rows) or groups < max(3, minimum_groups):
        raise ValueError(f"training needs {max(8, minimum_rows)} rows of {max(3, minimum_groups)} groups, not {n} of {groups}")
    grid = grid or GRIDS[kind]
    held, results, chosen = validate(training, kind, features, group, price, grid)
    best = min(range(len(results)), key=lambda i: (results[i]["median_absolute_log_error"], i))
    params = candidates(grid)[best]
    rows = training.select(F.log(F.col(price).cast("double")).alias("y"), *(F.col(c).cast("double").alias(c) for c in features)).toPandas()
    rows = rows.sort_values(["y", *features])
    model = MAKERS[kind](params).fit(rows[list(features)].to_numpy(), rows["y"].to_numpy())
    rest = (held["y"] - held["predicted"]).to_numpy()
    actual, made = np.exp(held["y"].to_numpy()), np.exp(held["predicted"].to_numpy())
    spread = ((held["y"] - held["y"].mean()) ** 2).sum()
    low, high = np.quantile(rest, [0.1, 0.9])
    return Fitted(model, {
        "artifact_version": ARTIFACT_VERSION, "mode": "market_baseline" if kind == "market" else "cell_level", "n_rows": n, "n_groups": groups, "validation": "nested_grouped",
        "mae": float(np.abs(actual - made).mean()), "median_ae": float(np.median(np.abs(actual - made))), "median_ape": float(np.median(np.abs(actual - made) / actual)),
        "r2_log": float(1 - (rest**2).sum() / spread) if spread else None, "residual_log_q10": min(float(low), 0.0), "residual_log_q90": max(float(high), 0.0),
        "selected": params, "tuning": results, "outer_choices": chosen, "feature_names": list(features),
    })


def project(v: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """The nearest weights that sum to 1 and reach their floors."""
    free = 1 - floors.sum()
    u = v - floors
    s = np.sort(u)[::-1]
    c = (np.cumsum(s) - free) / np.arange(1, len(s) + 1)
    k = int(np.flatnonzero(s > c)[-1]) if (s > c).any() else 0
    return floors + np.maximum(u - c[k], 0)


def priors(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(prior, floors): priors at least at their floors, summing to 1."""
    floors = np.array([float(model["minimum_weights"].get(c, 0)) for c in COMPONENTS])
    if floors.sum() > 1 + 1e-9:
        raise ValueError("minimum weights must sum to at most 1")
    prior = np.maximum([float(model["prior_weights"].get(c, 0)) for c in COMPONENTS], floors)
    return prior / prior.sum(), floors


def fit_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray, floors: np.ndarray, penalty: float) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, slope) of y = intercept + slope * x.weights, slope from 0 to 5,
    with penalty * |weights - prior|**2; by projected gradient steps on the weights, the
    line being refitted for each."""
    w = w / w.sum()

    def line(v: np.ndarray) -> tuple[float, float]:
        s = x @ v
        ms, my = w @ s, w @ y
        var = w @ (s - ms) ** 2
        slope = float(np.clip((w @ ((s - ms) * (y - my))) / var if var > 0 else 0.0, 0.0, 5.0))
        return my - slope * ms, slope

    def loss(v: np.ndarray) -> float:
        a, b = line(v)
        return w @ (y - a - b * (x @ v)) ** 2 + penalty * ((v - prior) ** 2).sum()

    v = project(prior, floors)
    now, step = loss(v), 1.0
    for _ in range(5000):
        a, b = line(v)
        gradient = -2 * b * x.T @ (w * (y - a - b * (x @ v))) + 2 * penalty * (v - prior)
        while step > 1e-12:
            new = project(v - step * gradient, floors)
            after = loss(new)
            if after <= now:
                break
            step /= 2
        done = now - after < 1e-13
        v, now, step = new, min(now, after), step * 2
        if done:
            break
    return v, *line(v)


def fit_weight_model(labels: DataFrame, model: dict, price: str = "price_per_sqm_php", listings: str = "listing_observations") -> dict:
    """Weights of the components from labelled cells; the penalty is chosen by leaving
    each label out in turn (median relative, then mean absolute error)."""
    columns = [f"norm_{c}" for c in COMPONENTS]
    rows = labels.select(*columns, F.col(price).cast("double").alias("p"), F.greatest(F.col(listings).cast("double"), F.lit(1.0)).alias("n")).limit(MOST_ROWS + 1).toPandas()
    if not model["minimum_labels"] <= len(rows) <= MOST_ROWS:
        raise ValueError(f"weights need {model['minimum_labels']} to {MOST_ROWS} labels, not {len(rows)}")
    rows = rows.sort_values([*columns, "p", "n"])
    x, p, w = rows[columns].to_numpy(float), rows["p"].to_numpy(float), np.sqrt(rows["n"].to_numpy(float))
    prior, floors = priors(model)
    results = []
    for penalty in model["regularization_grid"]:
        made = np.zeros(len(p))
        for i in range(len(p)):
            keep = np.arange(len(p)) != i
            v, a, b = fit_weights(x[keep], np.log(p[keep]), w[keep], prior, floors, penalty)
            made[i] = np.exp(a + b * (x[i] @ v))
        results.append({"regularization": penalty, "median_ape": float(np.median(np.abs(made - p) / p)), "mae": float(np.abs(made - p).mean())})
    best = min(results, key=lambda r: (r["median_ape"], r["mae"]))
    v, a, b = fit_weights(x, np.log(p), w, prior, floors, best["regularization"])
    return {
        "artifact_version": WEIGHT_VERSION, "components": list(COMPONENTS), "weights": dict(zip(COMPONENTS, map(float, v), strict=True)),
        "prior_weights": dict(zip(COMPONENTS, map(float, prior), strict=True)), "minimum_weights": dict(zip(COMPONENTS, map(float, floors), strict=True)),
        "intercept": float(a), "slope": float(b), "n_labels": len(p), "validation": "leave_one_out", "tuning": results, **{f"selected_{k}": r for k, r in best.items()},
    }


def save_json(metadata: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(metadata, indent=2))


def load_weights(path: str | Path) -> dict:
    """{"status": "trained", ...}, or not_trained, or error for an artifact of another
    version or order of components."""
    if not Path(path).exists():
        return {"status": "not_trained"}
    try:
        found = json.loads(Path(path).read_text())
        if found.get("artifact_version") != WEIGHT_VERSION:
            raise ValueError("unsupported artifact version")
        if tuple(found.get("components", ())) != COMPONENTS:
            raise ValueError("component order mismatch")
    except (ValueError, OSError) as e:
        return {"status": "error", "error": f"{type(e).__name__}: {e}"}
    return {"status": "trained", **found}


def save_model(fitted: Fitted, path: str | Path) -> None:
    """The model beside a readable description."""
    import pickle

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(pickle.dumps(fitted))
    save_json(fitted.metadata, Path(path).with_suffix(".json"))


def load_model(path: str | Path) -> tuple[Fitted | None, dict]:
    """(model or None, status): only load files that this engine has written."""
    import pickle

    if not Path(path).exists():
        return None, {"status": "not_trained"}
    try:
        found = pickle.loads(Path(path).read_bytes())
        if found.metadata.get("artifact_version") != ARTIFACT_VERSION:
            raise ValueError("unsupported artifact version")
    except Exception as e:  # a bad optional artifact must not stop a run
        return None, {"status": "error", "error": f"{type(e).__name__}: {e}"}
    return found, {"status": "trained", **found.metadata}
