"""Engine settings. One frozen dataclass; every operator takes what it needs as arguments with these defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from types import MappingProxyType

CHANNELS = ("name_tok", "name_chr", "addr_tok", "addr_num", "joint")


@dataclass(frozen=True)
class EngineConfig:
    # Retrieval
    channel_topk: int = 250
    score_floor: float = 0.08
    df_share: float = 0.03
    df_floor: int = 50
    min_df: int = 1
    rrf_constant: int = 60
    rank_base: int = 1
    reverse_topk: int = 5
    reverse_df_share: float = 0.005
    candidate_cap: int = 150
    cap_by_country: MappingProxyType = field(default_factory=lambda: MappingProxyType({"india": 200}))
    pruner_cap: int = 20
    # Decision
    keep_prob: float = 0.02
    min_prob: float = 0.05
    default_threshold: float = 0.7
    ladder: tuple[float, float, float] = (-0.05, 0.05, 0.05)
    certain: float = 0.99
    rescue_prob: float = 0.10
    rescue_lead: float = 0.30
    rescue_links: int = 11
    fp_weight: float = 1.9
    # Learning
    hard_ranks: int = 25
    easy_share: float = 0.35
    mask_share: float = 0.25
    smoothing: float = 20.0

    def cap_for(self, country: str) -> int:
        return self.cap_by_country.get(country, self.candidate_cap)

    def to_json(self) -> str:
        return json.dumps(asdict(replace(self, cap_by_country={})) | {"cap_by_country": dict(self.cap_by_country)}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        raw = json.loads(text)
        return cls(**raw | {"ladder": tuple(raw["ladder"]), "cap_by_country": MappingProxyType(raw["cap_by_country"])})
