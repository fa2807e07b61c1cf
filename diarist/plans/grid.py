"""Space-filling parameter grids."""

import hashlib

# Tuning ranges per parameter: kind, low, high. "log10" and "log2" give exponents.
RANGES = {
    "rf": {"mtry": ("int", 1, None), "min_n": ("int", 2, 40)},
    "svm": {"cost": ("log2", -10, 5), "rbf_sigma": ("log10", -10, 0)},
    "elnet": {"penalty": ("log10", -10, 0), "mixture": ("real", 0, 1)},
    "xgb": {
        "tree_depth": ("int", 1, 15), "min_n": ("int", 2, 40), "loss_reduction": ("log10", -10, 1.5),
        "sample_size": ("real", 0.1, 1), "mtry": ("int", 1, None), "learn_rate": ("log10", -10, -1),
    },
}
SIZES = {"rf": 10, "svm": 10, "elnet": 10, "xgb": 30}
TREES = {"rf": 500, "xgb": 1000}


def _draw(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def param_grid(model: str, n_features: int, size: int | None = None, seed=555, trees: int | None = None):
    """``size`` parameter sets as dicts: a Latin hypercube, each range cut into ``size`` strata
    and every stratum used once. ``mtry`` goes up to the number of features."""
    size = size or SIZES[model]
    grid = [{"param_id": i} for i in range(size)]
    for name, (kind, low, high) in RANGES[model].items():
        high = n_features if high is None else high
        strata = sorted(range(size), key=lambda i: _draw(f"{seed}:{model}:{name}:{i}"))
        for i, stratum in enumerate(strata):
            inside = _draw(f"{seed}:{model}:{name}:{i}:at") / 16**12
            x = low + (high - low) * (stratum + inside) / size
            if kind == "int":
                x = min(high, int(low + (high + 1 - low) * (stratum + inside) / size))
            grid[i][name] = {"log10": 10.0**x, "log2": 2.0**x}.get(kind, x)
    if model in TREES:
        for row in grid:
            row["trees"] = trees or TREES[model]
    return grid
