"""What media programs are asked: decoders, arguments, and the warm-up of models. Nothing here runs a program."""

from __future__ import annotations

import os

from ..errors import HwaccelUnavailableError, MissingVideoError

#: Hardware decoders in the order in which 'auto' takes them.
PREFERRED = ("cuda", "videotoolbox")


def parse_decoders(listing: str) -> tuple[str, ...]:
    """Names in a program's list of hardware decoders; its heading and blank lines are left out."""
    rows = (x.strip() for x in listing.splitlines())
    return tuple(x for x in rows if x and not x.lower().startswith("hardware acceleration"))


def decoder(wanted: str, have: tuple[str, ...]) -> str:
    """The decoder to use, 'none' for the processor. One asked for by name must be there; 'auto' takes the first that is."""
    wanted = (wanted or "none").lower()
    if wanted in ("none", "cpu"):
        return "none"
    if wanted == "auto":
        return next((x for x in PREFERRED if x in have), "none")
    if wanted not in have:
        raise HwaccelUnavailableError(f"no hardware decoder {wanted}; there are {', '.join(have) or 'none'}")
    return wanted


def attempts(wanted: str, have: tuple[str, ...]) -> list[str]:
    """Decoders to try in turn: where 'auto' chose one, the processor may follow once."""
    first = decoder(wanted, have)
    return [first, "none"] if first != "none" and (wanted or "").lower() == "auto" else [first]


def frame_arguments(path: str, video_index: int | None, fps: float, accel: str = "none", width: int = 0, picture: str = "jpg", quality: int = 2) -> list[str]:
    """Arguments that extract frames at a fixed rate. The output pattern is relative, so that no percent sign of a folder is read as a number's place."""
    if video_index is None:
        raise MissingVideoError(f"{path} has no video")
    filters = [f"fps={fps:g}"] + ([f"scale={width}:-2"] if width else [])
    out = ["-nostdin", "-hide_banner", "-v", "error", "-y"]
    out += [] if accel == "none" else ["-hwaccel", accel]
    out += ["-i", os.path.abspath(path), "-map", f"0:{video_index}", "-an", "-sn", "-dn", "-vf", ",".join(filters)]
    out += ["-q:v", str(quality)] if picture == "jpg" else []
    return [*out, "-start_number", "0", f"frame_%06d.{picture}"]


def audio_arguments(path: str, track_index: int, rate: int, target: str) -> list[str]:
    """Arguments that extract one track as mono 16-bit samples, aligned to the container's start."""
    return ["-nostdin", "-hide_banner", "-v", "error", "-y", "-i", os.path.abspath(path), "-map", f"0:{track_index}", "-vn", "-sn", "-dn", "-ac", "1", "-ar", str(rate), "-af", "aresample=async=1:first_pts=0", "-c:a", "pcm_s16le", "-f", "wav", target]


def warm_up_plan(settings, available: dict[str, bool]) -> list[tuple[str, str]]:
    """(target, what to do) for the models that settings name: 'ready', 'fetch', or 'skip' where nothing is needed."""
    st, so = settings.speech_transcription, settings.slide_ocr
    wanted = [("ocr:" + so.backend, True), ("asr:" + st.backend, True), ("vad:silero", st.vad_backend != "energy"), ("punctuation:" + st.punctuation, st.punctuation != "none")]
    return [(name, "skip" if not needed else "ready" if available.get(name) else "fetch") for name, needed in wanted]


#: Variables that keep model libraries off the network.
OFFLINE = {"HF_HUB_OFFLINE": "1", "TRANSFORMERS_OFFLINE": "1", "HF_DATASETS_OFFLINE": "1"}


def offline(environment: dict) -> dict:
    """An environment for worker processes in which model libraries stay off the network."""
    return {**environment, **OFFLINE}
