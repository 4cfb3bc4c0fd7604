"""Encoders by name: what they are and how they run over series of frames.

An encoder is a function from frames (keys, f, vec) to frames; its front end, if it has one, sees the whole series first, and the
encoder then runs over segments with left context, so that a series of any length is many tasks. Neural encoders would be
registered in the same way, with an Arrow kernel as their function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import signal as sig

Frames = Callable[[DataFrame, list[str]], DataFrame]


@dataclass(frozen=True)
class Encoder:
    """name, frames a second, look-ahead in ms, whether it is causal, segment and left context in frames (0: whole series), the front end and the encoder itself."""

    name: str
    run: Frames
    frame_hz: float = 50
    lookahead_ms: int = 0
    causal: bool = True
    segment: int = 0
    context: int = 0
    frontend: Frames | None = None

    def encode(self, frames: DataFrame, keys: list[str]) -> DataFrame:
        """keys, f, vec of the encoder."""
        x = self.frontend(frames, keys) if self.frontend else frames.select(*keys, "f", "vec")
        return sig.stitched(x, keys, self.segment, self.context, self.run) if self.segment else self.run(x, keys)


REGISTRY: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    """Add an encoder; a name is given once."""
    if encoder.name in REGISTRY:
        raise ValueError(f"there is an encoder {encoder.name!r} already")
    REGISTRY[encoder.name] = encoder
    return encoder


def encoder(name: str) -> Encoder:
    if name not in REGISTRY:
        raise ValueError(f"no encoder {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def described(spark: SparkSession) -> DataFrame:
    """A row for each encoder."""
    rows = [(e.name, float(e.frame_hz), e.lookahead_ms, e.causal, e.segment, e.context, e.frontend is not None) for e in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, frame_hz double, lookahead_ms int, causal boolean, segment int, context int, has_frontend boolean")


def _plain(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.select(*keys, "f", F.transform("vec", lambda x: x.cast("double")).alias("vec"))


register(Encoder("plain", _plain))
register(Encoder("mean3", lambda x, k: sig.running_mean(x, k, 3)))
register(Encoder("mean3-cut", lambda x, k: sig.running_mean(x, k, 3), segment=10, context=2))
register(Encoder("normal-mean3", lambda x, k: sig.running_mean(x, k, 3), segment=10, context=2, frontend=sig.z_normalized))
