"""Default parameters of the four corpus stages."""

from __future__ import annotations

from dataclasses import dataclass, field

# Special tokens written by the cleaner and by the byte-pair vocabulary.
MASK_TOKENS = ("<url>", "<email>", "<number>", "<date>")
MODEL_TOKENS = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")
SPECIAL_TOKENS = MASK_TOKENS + MODEL_TOKENS

# Published layout, split name -> folder name, and the two header lines.
PUBLISHED_NAMES = {"train": "train", "dev": "dev-0", "test": "test-A"}
IN_HEADER = ("InText", "Time")
EXPECTED_HEADER = ("Labels",)


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.7
    test: float = 0.2
    dev: float = 0.1
    parts: int = 3


@dataclass(frozen=True)
class LanguageModelConfig:
    vocab_size: int = 16000
    min_frequency: int = 2
    max_length: int = 512
    mlm_probability: float = 0.15
    special_tokens: tuple[str, ...] = SPECIAL_TOKENS


@dataclass(frozen=True)
class ClassifierConfig:
    threshold: float = 0.5
    max_length: int = 512
    apply_sigmoid: bool = False


@dataclass(frozen=True)
class EngineConfig:
    split: SplitConfig = field(default_factory=SplitConfig)
    lm: LanguageModelConfig = field(default_factory=LanguageModelConfig)
    classifier: ClassifierConfig = field(default_factory=ClassifierConfig)
