"""Settings of a linkage job."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    ngram: int = 3
    min_df: int = 2
    max_df: float = 0.02
    max_df_floor: int = 20_000
    max_features: int = 400_000
    threshold: float = 0.05
    by_state: bool = True
    k_name: int = 20
    k_name_addr: int = 20
    k_addr: int = 10
    k_reverse: int = 3
    exact_block_cap: int = 300
    max_union_per_s1: int = 150
    prune_top: int = 20
    prune_min_p: float = 0.003
    folds: int = 5
    hidden: float = 0.15
    iterations: int = 30
    depth: int = 5
    max_train_rows: int = 2_000_000
    seed: int = 7
    decision_rule: str = "auto"
    one_to_one: bool = True
    decision_threshold: float = 0.5
    margin: float = 0.0
    max_matches_per_s1: int = 12
    tune_max_s1: int = 200_000
    translit_min_count: int = 2
    translit_runner_up_share: float = 0.2
    segmenter_min_count: int = 3
    city_min_count: int = 2

    @classmethod
    def of(cls, values: dict) -> Config:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise KeyError(f"no setting {', '.join(sorted(unknown))}")
        return cls(**values)

    def having(self, **values) -> Config:
        Config.of(values)
        return replace(self, **values)

    def json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)
