"""Codec parameters, their two presets and their validation."""

from __future__ import annotations

from dataclasses import dataclass, replace

PREDICTORS = {"mean": 0, "linear": 1, "rw": 2}
CODINGS = {"raw": 0, "varint": 1}
MOST_POINTS, MOST_SEGMENTS = 10_000_000, 1_000_000


@dataclass(frozen=True)
class CodecParams:
    segment_mode: str = "fixed"
    segment_length: int = 64
    min_segment_length: int = 32
    max_segment_length: int = 128
    mse_threshold: float = 0.5
    predictor: str = "linear"
    residual_coding: str = "raw"
    c_q: float = 0.5
    q_min: float = 1e-6

    def __post_init__(self) -> None:
        if self.segment_mode not in ("fixed", "adaptive"):
            raise ValueError(f"Unsupported segment_mode: {self.segment_mode}")
        if self.predictor not in (*PREDICTORS, "auto"):
            raise ValueError(f"Unsupported predictor: {self.predictor}")
        if self.residual_coding not in CODINGS:
            raise ValueError(f"Unsupported residual_coding: {self.residual_coding}")
        if self.segment_mode == "fixed" and self.segment_length <= 0:
            raise ValueError("segment_length must be positive")
        if self.segment_mode == "adaptive" and (self.min_segment_length <= 0 or self.max_segment_length < self.min_segment_length):
            raise ValueError("0 < min_segment_length <= max_segment_length is required")

    def but(self, **changes) -> CodecParams:
        return replace(self, **changes)


#: The defaults of the Python interface and of the command line.
API = CodecParams()
CLI = CodecParams(segment_mode="adaptive", residual_coding="varint")
