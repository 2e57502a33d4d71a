"""Options and the model registry."""

from __future__ import annotations

from dataclasses import dataclass, field

# Model name -> context size in tokens and encoding name.
# They must equal the reference's registry so that limits agree.
MODEL_CONFIGS: dict[str, dict] = {
    "gpt-3.5": {"tokens": 4096, "encoding": "cl100k_base"},
    "gpt-4": {"tokens": 8192, "encoding": "cl100k_base"},
    "gpt-4-32k": {"tokens": 32768, "encoding": "cl100k_base"},
    "claude": {"tokens": 8192, "encoding": "cl100k_base"},
    "claude-2": {"tokens": 100000, "encoding": "cl100k_base"},
    "gpt-4o": {"tokens": 16384, "encoding": "cl100k_base"},
}


def validate_factor(factor: float) -> float:
    """The reduction factor must lie in (0, 1]."""
    if not (0 < factor <= 1.0):
        raise ValueError(f"factor {factor} is outside (0, 1]")
    return float(factor)


def model_config(model_name: str) -> dict:
    """Look a model up; unknown names list the choices."""
    if model_name not in MODEL_CONFIGS:
        raise ValueError(f"no limit is known for model {model_name!r}; known models: {', '.join(MODEL_CONFIGS)}")
    return MODEL_CONFIGS[model_name]


def token_limit(model_name: str = "gpt-4", factor: float = 1.0) -> int:
    """``int(tokens * factor)`` (truncation), never below 1.

    A limit of 0 would make bisection loop forever in the reference; we refuse
    it before any job starts (deliberate divergence).
    """
    limit = int(model_config(model_name)["tokens"] * validate_factor(factor))
    if limit < 1:
        raise ValueError(f"token limit {limit} is below 1; raise the reduction factor")
    return limit


@dataclass(frozen=True)
class ChunkOptions:
    """Options of one import run (re-aimed command-line options)."""

    model_name: str = "gpt-4"
    factor: float = 1.0
    counter: str = "regex"  # regex | chars | bpe | auto (bpe, else regex + lossless split; reported)
    splitter: str = "dot"  # dot | lossless  (strategy A sentence split)
    order: str = "reference"  # reference (right halves first) | document
    on_special: str = "error"  # bpe only: error | text
    engine: str = "arrow"  # arrow (pandas UDF packer) | catalyst (JVM only; strategy A, regex/chars)
    run_id: str = "run-0"
    run_ts: str = "1970-01-01 00:00:00"
    limit_override: int | None = None
    extra: dict = field(default_factory=dict)

    @property
    def limit(self) -> int:
        if self.limit_override is not None:
            if self.limit_override < 1:
                raise ValueError("token limit must be at least 1")
            return int(self.limit_override)
        return token_limit(self.model_name, self.factor)
