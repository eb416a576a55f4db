"""Extension points: functions on DataFrames and columns, by dotted path or registered name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each hook takes and gives.
CONTRACTS = {
    "rollout": "(spark, config, rollout_id, evaluation=False) -> DataFrame",
    "generate": "(rows: DataFrame) -> DataFrame, one row to any number of rows",
    "reward": "(response: Column, label: Column) -> Column, or (group: pandas) -> pandas for a whole group",
    "group_filter": "(samples: DataFrame) -> DataFrame(key, keep, reason); a plain boolean column keep is wrapped",
    "buffer_filter": "(buffer: DataFrame, n) -> (selected, remaining)",
    "sample_filter": "(samples: DataFrame) -> Column, true removes the sample from the loss",
    "all_samples": "(samples: DataFrame) -> None, sees dropped samples too",
    "data_postprocess": "(batch: DataFrame) -> DataFrame",
    "loss": "(batch: DataFrame) -> Column",
    "importance": "(train: Column, rollout: Column, mask: Column) -> (weights, mask)",
    "loss_reducer": "(loss: Column, mask: Column) -> aggregate Column",
    "advantage": "(batch: DataFrame) -> DataFrame with advantages and returns",
    "reward_postprocess": "(samples: DataFrame) -> DataFrame with norm_reward",
    "convert": "(samples: DataFrame) -> DataFrame of training columns",
    "log": "(metrics: DataFrame) -> bool, true skips the default log",
    "data_source": "object with get(n), add(groups), save(id), load(id), length()",
    "evaluation": "as rollout",
    "generator": "module with TASK_TYPE and run(rows)",
}
_NAMED: dict[tuple[str, str], Callable] = {}


def load(path: str) -> Callable:
    """The object at a dotted path."""
    module, _, name = path.rpartition(".")
    return getattr(import_module(module), name)


def register(hook: str, name: str) -> Callable[[Callable], Callable]:
    if hook not in CONTRACTS:
        raise ValueError(f"unknown hook {hook}")

    def keep(f: Callable) -> Callable:
        _NAMED[hook, name] = f
        return f

    return keep


def get(hook: str, name: str) -> Callable:
    return _NAMED[hook, name] if (hook, name) in _NAMED else load(name)


def decide(hook: Callable | None, samples: DataFrame, key: list[str]) -> DataFrame:
    """Group decisions of a filter; no filter keeps every group, a filter without reasons gets null ones."""
    if hook is None:
        return samples.select(*key).distinct().select(*key, F.lit(True).alias("keep"), F.lit(None).cast("string").alias("reason"))
    out = hook(samples)
    return out if "reason" in out.columns else out.withColumn("reason", F.lit(None).cast("string"))


def process_samples(samples: DataFrame, keep: Column | None = None, callback: Callable | None = None) -> DataFrame:
    """The samples kept for training; a callback sees all of them first."""
    if callback is not None:
        callback(samples)
    return samples if keep is None else samples.where(keep)


def log(metrics: DataFrame, sink: Callable, hook: Callable | None = None) -> bool:
    """Send the metrics to the sink unless a hook takes them over; whether the sink was used."""
    if hook is not None and hook(metrics):
        return False
    sink(metrics)
    return True


def override(dataset: dict, defaults: dict, arguments: dict, fields: list[str]) -> dict:
    """Settings by precedence: the dataset's own, the defaults, the arguments."""
    return {f: next((x[f] for x in (dataset, defaults, arguments) if x.get(f) is not None), None) for f in fields}


def dataset_list(config) -> list[dict]:
    """One dataset or many, as a mapping by name, a list of mappings or name / path pairs."""
    if config is None:
        return []
    if isinstance(config, dict):
        return [config] if "path" in config else [{"name": k, **(v if isinstance(v, dict) else {"path": v})} for k, v in config.items()]
    out = list(config)
    if all(isinstance(x, str) for x in out):
        if len(out) % 2:
            raise ValueError("names and paths must come in pairs")
        return [{"name": a, "path": b} for a, b in zip(out[::2], out[1::2])]
    return [dict(x) for x in out]
