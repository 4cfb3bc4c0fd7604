"""Rates, limits and label sets of the conversation model."""

from __future__ import annotations

FRAME_MS = 20  # 50 Hz frames
CHUNK_MS = 80  # 12.5 Hz chunks
# Corpus labels by category.
SPEECH_LABELS = ("Normal Turn", "Acknowledgement Backchannel", "Continuer Backchannel", "Filler", "Speech, Non-Linguistic", "Laughter")
NONSPEECH_LABELS = ("Non-Speech Noise", "Channel Bleed")
BACKCHANNEL_LABELS = ("Acknowledgement Backchannel", "Continuer Backchannel")
# Seconds of the four future bins at 12.5 Hz and at any other rate, and the upper edges of the onset bins.
FUTURE_BINS_S = {12.5: (0.16, 0.4, 0.64, 0.8)}
OTHER_FUTURE_BINS_S = (0.2, 0.4, 0.6, 0.8)
ONSET_EDGES_S = (0.16, 0.32, 0.64, 1.28, 2.56)


def future_bins(hz: float) -> list[int]:
    """Frames in each of the four future bins."""
    return [round(s * hz) for s in FUTURE_BINS_S.get(hz, OTHER_FUTURE_BINS_S)]


def onset_edges(hz: float) -> list[float]:
    """Upper edges of the time-to-onset bins, in frames."""
    return [s * hz for s in ONSET_EDGES_S]
