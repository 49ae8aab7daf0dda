"""Settings with their defaults. None stands for "default", so an explicit zero can be given (an extension on purpose)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class VadConfig:
    threshold: float = 0.5
    neg_threshold: float | None = None
    min_speech_ms: float = 0.0
    max_speech_s: float = math.inf
    min_silence_ms: float = 2000.0
    pad_ms: float = 400.0
    min_silence_at_max_ms: float = 98.0
    split_at_longest_silence: bool = False
    onset: float = 0.5
    offset: float = 0.363

    @property
    def off(self) -> float:
        """The score below which speech ends: 0.15 under the threshold, 0.01 at least, unless given."""
        return max(self.threshold - 0.15, 0.01) if self.neg_threshold is None else self.neg_threshold


@dataclass(frozen=True)
class TranscribeConfig:
    language: str | None = None
    task: str = "transcribe"
    beam_size: int = 5
    best_of: int = 5
    patience: float = 1.0
    length_penalty: float = 1.0
    repetition_penalty: float = 1.0
    no_repeat_ngram_size: int = 0
    temperatures: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    compression_ratio_threshold: float = 2.4
    logprob_threshold: float = -1.0
    no_speech_threshold: float = 0.6
    condition_on_previous_text: bool = True
    #: Above this temperature the context is dropped; None never drops it.
    prompt_reset_on_temperature: float | None = 0.5
    initial_prompt: str | None = None
    prefix: str | None = None
    hotwords: str | None = None
    suppress_blank: bool = True
    suppress_tokens: tuple[int, ...] = (-1,)
    without_timestamps: bool = False
    max_initial_timestamp: float = 1.0
    max_new_tokens: int | None = None
    word_timestamps: bool = False
    prepend_punctuations: str = "\"'“¿([{-"
    append_punctuations: str = "\"'.。,，!！?？:：”)]}、"
    hallucination_silence_threshold: float | None = None
    filter_phrases: bool = True
    vad_filter: bool = False
    vad: VadConfig = field(default_factory=VadConfig)
    clips: tuple[tuple[float, float], ...] = ()
    chunk_length_s: float = 30.0
    batch_size: int = 8


#: Voice activity settings of the batched mode, by backend; speech is cut at the chunk length there.
BATCHED_VAD = {
    "frames": VadConfig(threshold=0.2, neg_threshold=0.1, min_silence_ms=500, pad_ms=800),
    "overlap": VadConfig(min_silence_ms=160),
}


def batched_vad(backend: str, chunk_length_s: float) -> VadConfig:
    return replace(BATCHED_VAD[backend], max_speech_s=chunk_length_s)


@dataclass(frozen=True)
class StreamConfig:
    threshold: float = 0.5
    neg_threshold: float | None = None
    min_speech_ms: float = 50.0
    min_silence_ms: float = 550.0
    pad_ms: float = 500.0
    buffer_s: float = 60.0
    #: Weight of the newest score in the running mean; zero or less turns smoothing off.
    alpha: float = 0.35

    @property
    def off(self) -> float:
        return max(self.threshold - 0.15, 0.01) if self.neg_threshold is None else self.neg_threshold


@dataclass(frozen=True)
class ModelConfig:
    device: str = "cpu"
    compute_type: str = "default"
    device_index: tuple[int, ...] = (0,)
    threads: int = 0
    workers: int = 1
    cache_dir: str | None = None
    local_only: bool = False
    vad_backend: str = "frames"
    vad_threads: int = 0
