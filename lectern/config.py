"""Tunable values, with the defaults the queries use. Fixed values that results depend on."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Knobs:
    """One value for each threshold of the pipeline; times in seconds unless named otherwise."""

    sample_rate: int = 16_000
    frame_samples: int = 512
    # word commitment and segments
    agreement_n: int = 2
    pause_split: float = 0.6
    max_segment: float = 3.5
    max_words: int = 18
    min_words: int = 3
    clause_words: int = 12
    # recogniser buffer
    chunk: float = 0.8
    max_buffer: float = 24.0
    # recogniser doubts
    no_speech: float = 0.65
    marginal_no_speech: float = 0.35
    logprob: float = -1.0
    compression: float = 2.4
    # gate and floor
    vad_db: float = -45.0
    vad_hangover: float = 0.6
    noise_fall: float = 0.20
    noise_rise: float = 0.0003
    open_snr: float = 8.0
    margin_db: float = 6.0
    bleed_corr: float = 0.60
    corr_frames: int = 24
    corr_min_frames: int = 8
    attack: float = 0.15
    hold: float = 0.7
    warmup: float = 1.0
    dead: float = 90.0
    # speakers
    assign: float = 0.68
    merge: float = 0.82
    refine: float = 0.35
    merge_every: int = 10
    max_speakers: int = 8
    conf_temp: float = 0.06
    margin_ref: float = 0.08
    new_conf_cap: float = 0.60
    min_conf: float = 0.45
    mixed_penalty: float = 0.60
    adapt_window: int = 20
    window: float = 1.5
    hop: float = 0.75
    min_voiced: float = 0.6
    voiced_range_db: float = 35.0
    voiced_floor_db: float = -55.0
    # scoring
    collar: float = 0.25
    tolerance: float = 0.02
    # choices: language of the talk, source of sound, who labels speakers, and what they know
    language: str = ""
    asr_source: str = "dominant"
    diarize: str = "embed"
    look_back: bool = True
    encoder: str = "spectral"
    vocabulary: tuple = ()
    phrases: tuple = ()
    channels: dict = field(default_factory=dict)

    @property
    def frame(self) -> float:
        return self.frame_samples / self.sample_rate

    def frames(self, seconds: float) -> int:
        """Whole frames in a time, one at least."""
        return max(1, int(seconds / self.frame))


def load(source: str) -> Knobs:
    """Knobs from JSON, or from lines of `key: value`; unknown keys are ignored, missing ones keep their default.

    In lines, lists and maps are written as in JSON; a list also as `- item`
    lines under its key, a map as indented `key: value` lines.
    """
    try:
        given = json.loads(source)
    except ValueError:
        given = _lines(source)
    start = Knobs()
    return Knobs(**{f.name: _as(getattr(start, f.name), given[f.name]) for f in fields(Knobs) if given.get(f.name) is not None})


def _lines(source: str) -> dict:
    given: dict = {}
    key = ""
    for line in (x.split("#")[0].rstrip() for x in source.splitlines()):
        inner, text = line[:1].isspace() or line.startswith("- "), line.strip()
        if inner and text.startswith("- ") and key:
            given[key] = [*(given.get(key) or []), _bare(text[2:])]
        elif inner and ":" in text and key:
            k, _, v = text.partition(":")
            given[key] = {**(given.get(key) or {}), _bare(k): _bare(v)}
        elif ":" in text:
            key, _, v = (x.strip() for x in text.partition(":"))
            given[key] = json.loads(v) if v[:1] in "[{" and v else _bare(v) or None
    return given


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _as(default, value):
    """value in the type of the default."""
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("true", "yes", "on", "1")
    return type(default)(value)


#: Language codes of translations.
LANGS = {
    "en": "English", "ru": "Русский", "sr": "Srpski", "de": "Deutsch", "fr": "Français", "es": "Español", "it": "Italiano",
    "pt": "Português", "tr": "Türkçe", "zh": "中文", "ja": "日本語", "ar": "العربية", "uk": "Українська", "pl": "Polski",
}

def languages(spark: SparkSession) -> DataFrame:
    """(lang, name) of the languages a viewer may choose."""
    return spark.createDataFrame([*LANGS.items()], "lang string, name string")


#: Phrases that recognisers invent on silence (case-insensitive regular expressions).
BOILERPLATE = (
    r"субтитр(ы|ов)\s+(сделал|создавал|подготовил|редактор)",
    r"подписывайтесь\s+на\s+канал",
    r"subtitles?\s+(by|provided\s+by)",
    r"thanks?\s+for\s+watching",
)

#: Words that are no key terms.
STOP_TERMS = ("который", "поэтому", "потому", "например", "сейчас", "может", "нужно", "будет", "こちら", "should", "because", "example")
