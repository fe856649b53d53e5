"""From corpora to a judged detector: configuration, splits, activations, training from disk."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import clean, detectors as D, encode as E, pairs, splits as P, steps as S
from .operators.features import FeatureConfig
from .sources import corpora as C, sinks

DTYPES = {"float32": "float", "float": "float", "float64": "double", "double": "double", "float16": "float", "bfloat16": "float"}


def spaces(value):
    """Mappings as attributes, at any depth."""
    if isinstance(value, Mapping):
        return SimpleNamespace(**{k: spaces(v) for k, v in value.items()})
    return value


def plain(value):
    """What spaces() was made of."""
    return {k: plain(v) for k, v in vars(value).items()} if isinstance(value, SimpleNamespace) else value


def load_config(path: str, entry: str | None = None) -> SimpleNamespace:
    """A configuration file, JSON by its name or else YAML; of several entries the named one, which must be there."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML takes the yaml module; JSON needs none") from e
        raw = yaml.safe_load(text)
    if entry is None:
        return spaces(raw)
    if entry not in raw:
        raise KeyError(f"no {entry!r} among {sorted(raw)}")
    return spaces(raw[entry])


@dataclass(frozen=True)
class ModelRecord:
    """A model as the encoder boundary knows it; its tensors are stored in the element type of dtype."""

    name: str
    layers: tuple[int, ...]
    hidden: int
    dtype: str = "float32"

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValueError(f"unknown dtype {self.dtype!r}; known are {sorted(DTYPES)}")

    @property
    def tensor(self) -> str:
        return f"array<array<{DTYPES[self.dtype]}>>"


def run_tag(user_share: float, injection_share: float, seed: int, most_users: int | None = None, most_injections: int | None = None) -> str:
    """A name for a run over sampled tasks: caps where given, else shares, and the seed."""
    user = f"u{most_users}" if most_users is not None else f"uf{user_share:g}"
    injection = f"i{most_injections}" if most_injections is not None else f"if{injection_share:g}"
    return f"{user}_{injection}_seed{seed}"


def place(root: str, model: str, split: str | None = None) -> str:
    """Where a model's activations of a split, or its detector, are."""
    return "/".join([root.rstrip("/"), model.replace("/", "_"), *([split] if split else [])])


def sample_meta(samples: DataFrame) -> DataFrame:
    """What is kept of a sample beside its tensors: all columns but the text and messages, and text_len."""
    kept = [c for c in samples.columns if c not in ("text", "messages")]
    return samples.select(*kept, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_len"))


def unify(sources: list[DataFrame], agent_source: str, attacks: int = 0, keep_unlocatable: bool = False, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """All sources' samples in splits: unlocatable positives dropped, counterfactual pairs added, repeated samples once."""
    rows = C.unify(*sources)
    if not keep_unlocatable:
        rows, _ = clean.drop_unlocatable(rows, clean.has_locator(F.col("malicious_idx"), F.col("injection_fragments"), F.col("injection_text")))
    if attacks:
        instructions = rows.where("label = 1").select("ord", F.coalesce("injection_text", "text").alias("payload"))
        rows = pairs.counterfactuals(rows, clean.payload_pool(instructions), attacks, seed)
    return P.make_splits(clean.with_id(rows), agent_source, ratio, seed)


def extract(spark: SparkSession, samples: DataFrame, root: str, model: ModelRecord, split: str, make: Callable[[], E.Encoder], again: bool = False, role: str = "tool") -> dict[str, int]:
    """Writes the activations that the sink lacks of a split's tool steps; samples have a sample_index."""
    meta = ["sample_index", "step_index", "task", "history", "post", "label", "trajectory_label", "source", "sample_type", "suite_name"]

    def encoded(steps: DataFrame) -> DataFrame:
        out = E.activations(steps, make)
        return out.select(*[F.col(c).cast(model.tensor).alias(c) if c in ("task", "history", "post") else F.col(c) for c in meta])

    return sinks.write_activations(S.tool_steps(samples, role), encoded, place(root, model.name, split), again=again)


def train_from_disk(
    spark: SparkSession, root: str, model: str, out: str, cfg: FeatureConfig = FeatureConfig(), n_anchors: int = 100, aggregation: str = "max", target_tpr: float = 0.95, max_fpr: float | None = None, seed: int = 42, test: bool = True, **params,
) -> tuple[D.Detector, dict[str, DataFrame]]:
    """Fits the main detector on the stored train split, sets its threshold on val, judges it on test, saves it under out."""
    read = lambda split: sinks.read_activations(spark, place(root, model, split))
    detector = D.fit_drift(read("train"), cfg, n_anchors, seed, **params)
    D.calibrate(detector, detector.features(read("val")), aggregation, target_tpr, max_fpr)
    judged = D.evaluate(detector, detector.features(read("test")), ("source", "sample_type", "suite_name")) if test else {}
    if test:
        detector.metrics["test"] = judged["metrics"].first().asDict()
    detector.save(spark, place(out, model))
    return detector, judged
