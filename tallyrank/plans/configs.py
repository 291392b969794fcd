"""Settings from JSON files: an experiment's file names a data set and models, whose own files hold their parameters."""

from __future__ import annotations

import copy
import json
import os

from ..sources.readers import plain_name

# The strategies that lead from one task's data to the other's, by task.
STRATEGIES = {"recs": ["query-as-user", "retrieval-as-user"], "search": ["centroid-vector", "tag-query"]}


def strategy(config: dict) -> str | None:
    """The bridging strategy of an experiment, however it is spelled; None if it has none. An unknown one is an error."""
    if not config.get("hybrid"):
        return None
    given = str(config.get("hybridStrategie", config.get("hybridStrategy", "")))
    plain = plain_name(given).replace("querry", "query")
    known = STRATEGIES[config["task_type"]]
    if plain not in map(plain_name, known):
        raise ValueError(f"strategy {given!r} is none of {known}")
    return next(k for k in known if plain_name(k) == plain)


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _listed(folder: str) -> list[tuple[str, dict]]:
    return [(n, read_json(os.path.join(folder, n))) for n in sorted(os.listdir(folder)) if n.endswith(".json")] if os.path.isdir(folder) else []


def dataset_settings(name: str, task: str, base: str, bridged: bool = False) -> dict | None:
    """Parameters of a data set: of the files in datasets/ that name it, a search task takes one with "search" in its
    name and a recommendation one without; a bridged recommendation, the one for retrieval as user."""
    files = _listed(os.path.join(base, "datasets"))
    if bridged:
        key = next((suffix for word, suffix in (("movie", "ml25m"), ("ml25", "ml25m"), ("lastfm", "lastfm"), ("amazon", "amazon")) if word in plain_name(name)), plain_name(name))
        return next((c for n, c in files if plain_name(n).startswith("retrievalasuser") and key in plain_name(n)), None)
    own = [(n, c) for n, c in files if plain_name(str(next((c.get("dataloader", {}).get(k) for k in ("dataset_name", "dataset", "name") if c.get("dataloader", {}).get(k)), ""))) == plain_name(name)]
    best = [c for n, c in own if ("search" in n.lower()) == (task == "search")] or [c for _, c in own]
    return best[0] if best else None


def model_settings(name: str, base: str) -> dict | None:
    """Parameters of a model: the file in models/ that has its type or name."""
    for _, config in _listed(os.path.join(base, "models")):
        inner = config.get("model", config)
        if plain_name(name) in [plain_name(str(inner[k])) for k in ("model_type", "model_name", "name") if inner.get(k)]:
            return inner
    return None


def resolved(config: dict, base: str | None = None) -> dict:
    """The experiment with data set and models as {"name", "params"}: what the experiment says itself goes before what
    the files say. `base` has datasets/ and models/; a `config_path` names a file itself."""
    out = copy.deepcopy(config)
    dataset = out.get("dataset", {})
    dataset = {"name": dataset} if isinstance(dataset, str) else dataset
    found: dict | None = read_json(_under(base, dataset["config_path"])) if "config_path" in dataset else None
    if found is None and base and dataset.get("name"):
        found = dataset_settings(dataset["name"], out.get("task_type", ""), base, out.get("task_type") == "recs" and bool(out.get("hybrid")) and strategy(out) == "retrieval-as-user")
    params = {k: v for k, v in (found or {}).get("dataloader", found or {}).items() if k not in ("dataset_name", "dataset", "name")}
    name = dataset.get("name") or (found or {}).get("dataloader", {}).get("dataset_name")
    out["dataset"] = {"name": name, "params": params | dataset.get("params", {})}
    models = []
    entries = out.get("model", [])
    for entry in [entries] if isinstance(entries, (str, dict)) else entries:
        entry = {"name": entry} if isinstance(entry, str) else entry
        inner = read_json(_under(base, entry["config_path"])) if "config_path" in entry else model_settings(entry["name"], base) if base and entry.get("name") else None
        inner = (inner or {}).get("model", inner or {})
        models.append({"name": entry.get("name") or inner.get("model_type"), "params": inner.get("parameters", inner.get("hyperparams", {})) | entry.get("params", entry.get("parameters", {}))})
    out["model"] = models
    # other names of the evaluation's settings
    evaluation = out.get("evaluation", {})
    for ours, theirs in (("positives", "n_pos_samples"), ("negatives", "n_neg_samples")):
        if theirs in evaluation:
            evaluation.setdefault(ours, evaluation[theirs])
    stats = evaluation.get("stats", {})
    for key in ("tests", "alpha", "symbol"):
        if key in stats:
            evaluation.setdefault(key, stats[key])
    if evaluation:
        out["evaluation"] = evaluation
    if "window_size" in out.get("execution", {}):
        out["split"] = {"window": out["execution"]["window_size"]} | out.get("split", {})
    return out


def _under(base: str | None, path: str) -> str:
    return path if os.path.isabs(path) or not base else os.path.join(base, path)
